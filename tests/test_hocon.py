import json

import pytest

from kinfold.sources.hocon import SyntaxProblem, parse

TEXT = """
# a project
link : {
    low : {alpha : 0.5, beta : 50.0} // shared below
    lev {
        name = "Levenshtein",
        parameters : { threshold : 7.0
            most : 10 }
    }
    data : {
        path : "./a b.csv", // null comes next
        file : null
        attributes : [
            {name : "x", fn : ${link.lev}, prior : ${link.low}},
            {name : "y", fn : ${link.lev} {parameters.threshold : 5}, prior : ${link.low},},
        ]
    }
    seed = 319158, resume : false
    steps : []
}
link.low.beta = 60
link.out : /tmp/run 1/results   # blanks inside stay
link.where : ${link.out}/chain
link.gone : ${?nowhere.to.be.found}
link.steps += one
link.steps += "two"
"k.q"."r" : \"\"\"a "quoted" line\"\"\"
"""


def test_whole_text():
    got = parse(TEXT)
    low = {"alpha": 0.5, "beta": 60}
    lev = {"name": "Levenshtein", "parameters": {"threshold": 7.0, "most": 10}}
    near = {"name": "Levenshtein", "parameters": {"threshold": 5, "most": 10}}
    assert got["link"]["low"] == low and got["link"]["lev"] == lev
    assert got["link"]["data"] == {"path": "./a b.csv", "file": None, "attributes": [{"name": "x", "fn": lev, "prior": low}, {"name": "y", "fn": near, "prior": low}]}
    assert (got["link"]["seed"], got["link"]["resume"], got["link"]["steps"]) == (319158, False, ["one", "two"])
    assert got["link"]["out"] == "/tmp/run 1/results" and got["link"]["where"] == "/tmp/run 1/results/chain"
    assert "gone" not in got["link"] and got["k.q"] == {"r": 'a "quoted" line'}


@pytest.mark.parametrize("tree", [{}, {"a": [1, -2.5, "x\né", None, True, {"b": {}}], "c d": "1"}, {"x": {"y": {"z": []}}}])
def test_json_is_a_part(tree):
    assert parse(json.dumps(tree)) == tree and parse(json.dumps(tree, indent=2)) == tree


@pytest.mark.parametrize("text", ["a : ${b}", "a : ${a}", "a : ${b}, b : ${a}", "a :", "a : {b : 1", "a : [1, 2", 'a : "x', "{a : 1} b", "a b", 'include "x.conf"', "a : {b : 1} 2", "a : x:y", ": 1", "a : ${b"])
def test_errors(text):
    with pytest.raises(SyntaxProblem):
        parse(text)


def test_the_last_value_holds():
    assert parse("a : 1\na : 2") == {"a": 2} and parse("a : {b : 1}\na : 2") == {"a": 2} and parse("a : 2\na.b : 1") == {"a": {"b": 1}}
    assert parse("x : {b : 1}\na : ${x}\na : {c : 2}") == {"x": {"b": 1}, "a": {"b": 1, "c": 2}}
    assert parse("a : 1.5e3, b : -7, c : 1.2.3, d : yes") == {"a": 1500.0, "b": -7, "c": "1.2.3", "d": "yes"}
