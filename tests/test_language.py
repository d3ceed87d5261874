"""The query language rule by rule, on a document of a garden: tokens, trees, folding, results, errors."""

import pytest

from treequill import ast as a
from treequill.errors import QueryError
from treequill.evaluate import Environment, results
from treequill.kinds import Multimap, kind_of, to_text
from treequill.lexer import tokenize
from treequill.parser import parse

GARDEN = {
    "title": "Fern", "n": 42, "none": None, "odd key": 7, "open": False,
    "site": {"name": "North Bed", "pos": {"lat": 52.25, "lon": -1.5}},
    "beds": [
        {"w": 3, "h": 4.5, "tags": ["sun", "dry"], "plant": {"id": "p1", "height": 30}},
        {"w": 5, "h": None, "tags": [], "plant": {"id": "p2", "height": 75}},
        {"w": 8, "tags": ["dry"], "plant": None},
    ],
    "codes": [10, 20, 30, 20],
}


def fails(env, ctx, args):
    raise QueryError("RuntimeError", "no water")
    yield


def environment():
    return Environment(constants={"season": 4},functions={"fails": fails}, unfoldable={"trace", "fails"})


def run(query, doc=GARDEN):
    env = environment()
    return [to_text(v) for v in results(parse(query, env), doc, env)]


def tree(query):
    return a.to_sexpr(parse(query, environment()))


class TestTokens:
    @pytest.mark.parametrize("text,kind,value", [
        ("0x1F", "int", 31), ("0b101", "int", 5), ("77", "int", 77), ("2.", "float", 2.0), (".25", "float", 0.25), ("25e-2", "float", 0.25), ("3.5e2", "float", 350.0),
    ])
    def test_numbers(self, text, kind, value):
        assert (tokenize(text)[0].kind, tokenize(text)[0].value) == (kind, value)

    @pytest.mark.parametrize("text,kind,value", [
        ("'it\\'s'", "string", "it's"), ('"a\\tb"', "string", "a\tb"), ("r'\\d+'", "string", "\\d+"), ("b'\\x00z'", "bytes", b"\0z"), ('""', "string", ""),
    ])
    def test_strings(self, text, kind, value):
        assert (tokenize(text)[0].kind, tokenize(text)[0].value) == (kind, value)

    def test_words_and_signs(self):
        kinds = [t.kind for t in tokenize("bed.*.h >= 2 and Not x or _ != **{y} = z... # w")]
        assert kinds[:13] == ["word", ".", "*", ".", "word", ">=", "int", "and", "not", "word", "or", "_", "!="]
        assert [t.value for t in tokenize("odd\\ key \\9lives")][:2] == ["odd key", "9lives"]

    @pytest.mark.parametrize("text", ["0b102", "0x", "12cd", "'open", 'x"', "b'\\xG1'"])
    def test_wrong_tokens_tell_where(self, text):
        with pytest.raises(QueryError) as e:
            tokenize(text)
        assert " at " in e.value.message


class TestFolding:
    """What does not depend on the document is computed when the query is read."""

    @pytest.mark.parametrize("query,expected", [
        ("7 - 2 * 3", "1"), ("(7 - 2) * 3", "15"), ("9 / 2", "4"), ("9 / 2.0", "4.500000"), ("9 % 4", "1"), ("-3 + 1", "-2"), ("~5", "-6"), ("6 & 3", "2"), ("6 | 3", "7"), ("6 ^ 3", "5"), ("3 << 4", "48"), ("256 >> 3", "32"),
        ("'dew' + 'drop'", '"dewdrop"'), ("'no ' + 7", '"no 7"'), ("#'moss'", "4"), ("'moss'[2]", '"s"'), ("2 < 10", "true"), ("'2' < '10'", "false"), ("2.5 == 2.50", "true"), ("true == 1", "false"), ("not true", "false"),
        ("'8' as int", "8"), ("8 as string", '"8"'), ("8 as float", "8.000000"), ("8 as bool", "true"), ("2.9 as int", "2"), ("b'\\x01\\x02' == 258", "true"), ("typeof 'x'", '"string"'), ("typeof null", '"null"'), ("typeof (1 == 1)", '"bool"'),
        ("7 = range(5, 9)", "true"), ("4 = range(5, 9)", "false"), ("range(2, 4)...", "{2 3 4}"), ("season * 2", "8"), ("GROUND == 'GROUND'", "true"), ("arr(4, 5)", "{4 5}"), ("sum(arr(4, 5))", "9"), ("count(arr(4, null, 5))", "2"), ("any(arr(false, true))", "true"), ("each(arr(false, true))", "false"),
        ("'fern' = re'f.*n'", '"fern"'), ("'fern' = re'f'", "false"), ("split('a-b', '-')", "{a b}"), ("null + 1", "null"), ("null == null", "true"), ("null < 1", "false"),
    ])
    def test_constants(self, query, expected):
        assert tree(query) == expected

    @pytest.mark.parametrize("query,expected", [
        ("beds.w", "(. beds w)"), ("beds.*.w + 1 * 2", "(+ (. (. beds *) w) 2)"), ("a and b or c", "(or (and a b) c)"), ("x < 3 + 4", "(< x 7)"), ("beds[1]", "(index beds 1)"), ("beds{w > 1}", "(sub beds (> w 1))"), ("not a", "(not a)"), ("title...", "(... title)"),
        ("typeof n", "(typeof n)"), ("n as string", "(string n)"), ("fails()", "(fails)"), ("count(beds)", "(count beds)"), ("any(beds.*.w)", "(any (. (. beds *) w))"), ("beds.GROUND", "(. beds GROUND)"),
    ])
    def test_trees(self, query, expected):
        assert tree(query) == expected

    @pytest.mark.parametrize("query", ["5 / 0", "5 % 0", "-'leaf'", "#3.5", "3 - true", "rake(1)", "range(2)", "split(1, '-')", "(n", "n)", "beds[", "re'('", "3 as soil"])
    def test_wrong_queries(self, query):
        with pytest.raises(QueryError):
            parse(query, environment())

    def test_a_lone_constant_is_looked_for_everywhere(self):
        assert a.to_sexpr(parse("40 + 2", auto_wildcard=True)) == "(== ** 42)"
        assert a.to_sexpr(parse("n == 42", auto_wildcard=True)) == "(== n 42)"


RESULTS = {
    "paths": [("title", ["Fern"]), ("site.pos.lat", ["52.250000"]), ("odd\\ key", ["7"]), ("['odd key']", ["7"]), ("missing", ["null"]), ("title.missing", ["null"]), ("none", ["null"]), ("_.n", ["42"]), ("site", ['{"name":"North Bed","pos":{"lat":52.25,"lon":-1.5}}'])],
    "children": [("codes.*", ["10", "20", "30", "20"]), ("site.pos.*", ["52.250000", "-1.500000"]), ("beds.*.w", ["3", "5", "8"]), ("beds.*.h", ["4.500000"]), ("beds.*.tags.*", ["sun", "dry", "dry"]), ("title.*", ["null"]), ("count(*)", ["6"])],
    "descent": [("site.**", ['{"name":"North Bed","pos":{"lat":52.25,"lon":-1.5}}', "North Bed", '{"lat":52.25,"lon":-1.5}', "52.250000", "-1.500000"]), ("**.id", ["p1", "p2"]), ("count(**.tags)", ["3"]), ("**.height{_ > 40}", ["75"]), ("count(codes.**)", ["5"])],
    "subscripts": [("codes[1]", ["20"]), ("codes[9]", ["null"]), ("codes[-1]", ["null"]), ("beds[0].plant.id", ["p1"]), ("codes[arr(2, 0)]", ["30", "10"]), ("title[0]", ["F"]), ("title[4]", ["null"]), ("site['name']", ["North Bed"]), ("codes[range(1, 2)...]", ["20", "30"])],
    "filters": [("beds.*{w > 4}.w", ["5", "8"]), ("codes.*{_ == 20}", ["20", "20"]), ("beds.*{h}.plant.id", ["p1"]), ("title{false}", ["null"]), ("beds.*{count(tags.*) == 2}.w", ["3"]), ("site{pos.lat > 50}.name", ["North Bed"]), ("beds.*{plant.height > 40 and w < 6}.w", ["5"])],
    "logic": [("none or n", ["42"]), ("n or title", ["42"]), ("n and title", ["Fern"]), ("open and n", ["false"]), ("not open", ["true"]), ("none and n", ["null"]), ("any(codes.* > 25)", ["true"]), ("each(codes.* > 25)", ["false"]), ("any(missing, n)", ["true"]), ("each(missing, n)", ["false"]), ("open?", ["false"]), ("none?", ["false"]), ("n?", ["true"])],
    "several values": [("codes.* + 1", ["11", "21", "31", "21"]), ("arr(1, 2) * arr(10, 100)", ["10", "100", "20", "200"]), ("codes.* == 20", ["false", "true", "false", "true"]), ("beds.*.w - n", ["-39", "-37", "-34"]), ("-codes.*", ["-10", "-20", "-30", "-20"])],
    "comparison": [("n == 42.0", ["true"]), ("title == 'Fern'", ["true"]), ("title == n", ["false"]), ("title != n", ["true"]), ("none == missing", ["true"]), ("none < 1", ["false"]), ("none <= none", ["true"]), ("n = range(40, 50)", ["true"]), ("n = range(50, 40)", ["true"]), ("title = re'F.+'", ["Fern"]), ("title != re'F.+'", ["false"]), ("title = re'G.+'", ["false"])],
    "kinds": [("typeof beds", ["model"]), ("typeof none", ["null"]), ("typeof site.pos.lat", ["float"]), ("n as float", ["42.000000"]), ("site.pos.lat as int", ["52"]), ("title as int", ["0"]), ("none as string", ["null"]), ("n as bytes == 42", ["true"]), ("#title", ["4"]), ("#codes", ["4"]), ("#site", ["2"])],
    "functions": [("sum(codes.*)", ["80"]), ("sum(codes.*, $sum + $val * $idx)", ["140"]), ("sum(codes.*, $sum - $val, 100)", ["20"]), ("count(codes.*)", ["4"]), ("count(beds.*.h)", ["1"]), ("keys(site)", ["name", "pos"]), ("count(keys(**))", ["37"]), ("split('a,b,', ',')", ["a", "b", ""]), ("split('a,b,', ',', false)", ["a", "b"]), ("select(codes.*, 1)", ["20"]), ("select(codes.*, 1, 2)", ["20", "30"]), ("arr(n, title)", ["42", "Fern"]), ("trace(n)", ["42"]), ("range(n, 44)...", ["42", "43", "44"])],
}


@pytest.mark.parametrize("rule,query,expected", [(rule, q, e) for rule, cases in RESULTS.items() for q, e in cases])
def test_results(rule, query, expected):
    assert run(query) == expected


def test_errors_of_a_run_come_only_where_a_value_is_asked_for():
    for query in ("fails()", "n + fails()", "n / (missing as int)"):
        with pytest.raises(QueryError):
            run(query)
    assert run("n or fails()") == ["42"] and run("open and fails()") == ["false"]


def test_whole_numbers_beyond_64_bits_are_errors():
    big = str(2**63 - 1)
    for query in (f"{big} + n", f"-{big} - n", f"{big} * n", f"{big} + 1"):
        with pytest.raises(QueryError):
            run(query)
    assert run(f"{big} - n + n") == [big] and run("1 << 63 < 0") == ["true"]


def test_bytes_are_printed_with_escapes():
    assert run("'A' as bytes") == ['b"A"'] and run("255 as bytes{true}")[0].startswith("b\"")
    assert run("b'\\xff\\x00q\"'") == ['b"\\xFF\\x00q\\""']


def test_characters_are_bytes_of_utf8():
    assert run("#word", {"word": "héllo"}) == ["6"] and run("word[0] + word[3]", {"word": "héllo"}) == ["hl"]
    assert run("word[1]", {"word": "héllo"}) == ["�"]


def test_kinds_of_python_values():
    assert [kind_of(x) for x in (None, False, 3, 0.5, "s", b"y", {"a": 1}, [1], Multimap([]))] == ["null", "bool", "int", "float", "string", "bytes", "model", "model", "model"]


def test_visitor_sees_every_node():
    seen = []
    a.visit(parse("beds.*{w > n}.plant", environment()), lambda node: seen.append(node.name) if isinstance(node, a.Field) else None)
    assert sorted(seen) == ["beds", "n", "plant", "w"]
