import pytest

from foliospark.plans.docql import Call, Comparison, MatchConfig, Name, TemplateError, as_array, as_boolean, as_number, as_string, literal_config, parse_template


def test_elements_attributes_and_children():
    t = parse_template('TextChunk(chunkOverlap=150, chunkSize=500,) Section(match="A \\" b", as="x", n=-2, f=0.85, ok=true) { Table Foo { Image } }')
    chunk, section = t.elements
    assert (chunk.type, chunk.attributes) == ("TextChunk", {"chunkSize": 500, "chunkOverlap": 150})
    assert section.attributes["match"] == 'A \\" b' and section.attributes["f"] == 850 and section.attributes["n"] == -2 and section.attributes["ok"] is True
    assert [c.type for c in section.children] == ["Table", "Unknown"] and section.children[1].name == "Foo"
    assert section.before() is chunk and chunk.after() is section and section.after() is None
    assert section.match == MatchConfig("text", 'A \\" b', 0.6)


def test_definitions_are_resolved():
    t = parse_template('Match<Section> M { FirstMatch(a, b) Text("Intro", 0.9, fuzzy=true) } Section(match=M, end_match=Missing) Match<Table> R { Regex("x+", 5) Cosine("y") "z" }')
    assert t.elements[0].match == MatchConfig("text", "Intro", 0.9, {"fuzzy": True}) and t.elements[0].end_match is None
    assert t.definitions["M"].clauses[0] == Call("FirstMatch", [Name("a"), Name("b")]) and t.definitions["M"].target == "Section"
    assert t.definitions["R"].clauses == [MatchConfig("regex", "x+", 1.0), MatchConfig("cosine", "y", 0.7), "z"]


@pytest.mark.parametrize("sign", [">", "<", ">=", "<=", "==", "!="])
def test_comparisons(sign):
    call = parse_template(f'Match<S> H {{ Heuristic(size {sign} 1.5, caps == true, name={{0}}) }}'.replace("{0}", '"q"')).definitions["H"].clauses[0]
    assert call.positional[0] == Comparison("size", sign, 1500) and call.positional[1].right is True and call.named == {"name": "q"}


def test_thresholds_and_lists():
    with pytest.warns(UserWarning):
        assert parse_template('Match<S> D { Text("a", 1) }').definitions["D"].clauses[0].threshold == 0.001
    assert parse_template('Section(match=["p", 600, "regex", ["k", 3]])').elements[0].match == MatchConfig("regex", "p", 0.6, {"k": 3})
    assert parse_template('Section(match=["p", 600])', empty_arrays=True).elements[0].match is None
    assert literal_config(["p"]) == MatchConfig("text", "p", 0.6) and literal_config(["p", 700, "odd"]).kind == "custom:odd" and literal_config(3) is None
    assert parse_template("Match<S> E { }").definitions["E"].clauses == []


def test_later_names_win_and_prefixes_of_booleans():
    t = parse_template('Match<A> D { Text("1") } Match<A> D { Text("2") } Section(match=D, a=1, a=trueish)')
    assert t.elements[0].match.pattern == "2" and t.elements[0].attributes["a"] == Name("trueish")


@pytest.mark.parametrize("bad", ["Section(", 'Section(match="a) {', "Section(match)", "1", 'X(a="\\s")', "// no", "Match<S> { }", "Section { ", "A(x=1 y=2)"])
def test_errors(bad):
    with pytest.raises(TemplateError):
        parse_template(bad)


def test_accessors():
    assert as_string(Name("a")) == as_string("a") == "a" and as_string(1) is None
    assert as_number(True) is None and as_number(2) == 2 and as_boolean(True) is True and as_boolean(1) is None and as_array([1]) == [1]
