"""JSON and YAML profiles against the standard parsers."""

import json

import pytest

import shelfmark as sm

SAMPLE = {
    "station": "Nordkap", "height": 307.5, "open": False, "winds": ["NE", "SW"],
    "masts": {"east": {"levels": 4}}, "gaps": [], "year": 1998,
}


def depth(value):
    children = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return max((1 + depth(c) for c in children), default=0)


def kind(value):
    for t, n in ((dict, "object"), (list, "array"), (str, "string"), (bool, "boolean"), ((int, float), "number")):
        if isinstance(value, t):
            return n
    return "null"


TEXTS = [
    json.dumps(SAMPLE, indent=2), "{}", "[]", "[[]]", '{"a":{}}', '[[],[[]],{"x":[{}]}]', "null", "true",
    " 12 ", '"x\\"y[{"', '{"a":"]}\\\\","b":["\\"["]}', '[1,true,"s",null,{"a":1},[2]]', '{"a":1} x', "1] x",
    "1} x", '1,"k":2', "", " ", "{", "[1,]", "{'a':1}", "01", "nul", '{"a":1}{"b":2}', '{"a":1,"a":2}',
    '{"é":"ü","\\u00e9x":1}', "-1.5e3", '{"a":1,}', '"unterminated', "// c\n1", '["a","b"]',
]


def parse(text):
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


@pytest.fixture(scope="module")
def profiled(rows):
    df = sm.json_profile(rows([(t,) for t in TEXTS], "content string"))
    return {r["content"]: r for r in df.collect()}


@pytest.mark.parametrize("text", TEXTS)
def test_json_matches_the_standard_parser(profiled, text):
    valid, value = parse(text)
    r = profiled[text]
    assert r["json_valid"] == valid
    if not valid:
        assert r["json_error"] and r["json_structure"] is None and r["json_depth"] is None
        return
    s = r["json_structure"]
    assert (s["type"], r["json_depth"], r["json_size"]) == (kind(value), depth(value), len(text))
    keys = list(value) if isinstance(value, dict) else []
    assert r["json_root_keys"] == keys and r["json_root_key_count"] == len(keys)
    if isinstance(value, dict):
        assert s["key_count"] == len(keys) and s["sample_keys"] == keys
    elif isinstance(value, (list, str)):
        assert s["length"] == len(value)
    if isinstance(value, list):
        assert s["sample_item_types"] == sorted({kind(v) for v in value})


def test_sample_document_goldens(profiled):
    r = profiled[TEXTS[0]]
    assert r["json_structure"]["sample_keys"] == ["station", "height", "open", "winds", "masts", "gaps", "year"]
    assert (r["json_root_key_count"], r["json_depth"]) == (7, 3)


def test_long_text_is_flagged_not_judged(rows):
    from pyspark.sql import functions as F

    from shelfmark.operators.semistructured import json_judgement, json_struct

    r = rows([('{"a": 1}',)], "content string").select(json_struct(F.col("content"), json_judgement(F.col("content"), 4), 4).alias("j")).head()["j"]
    assert r["json_truncated"] and r["json_valid"] is None and "limit" in r["json_error"]


def test_yaml_sample_and_odd_documents(rows):
    yaml = pytest.importorskip("yaml")
    texts = {
        "sample": yaml.dump(SAMPLE),
        "seq": "- 1\n- 2020-01-01\n- yes\n- null\n- {a: b}\n- [x]\n", "empty": "", "scalar": "hello",
        "several": "---\na: 1\n---\nb: 2\n", "broken": "a: [", "loop": "&a [*a]", "shared": "a: &x {k: [1]}\nb: *x\n",
        "keys": "1: a\nfalse: b\n",
    }
    df = sm.yaml_profile(rows(list(texts.items()), "name string, content string"))
    got = {r["name"]: r for r in df.collect()}
    s = got["sample"]
    assert s["yaml_structure"]["type"] == "mapping"
    assert s["yaml_structure"]["sample_keys"] == sorted(SAMPLE)
    assert (s["yaml_root_key_count"], s["yaml_depth"]) == (7, 3)
    kinds = ["boolean", "date", "mapping", "null", "number", "sequence"]
    assert got["seq"]["yaml_structure"]["sample_item_types"] == kinds
    assert got["empty"]["yaml_valid"] and got["empty"]["yaml_structure"]["type"] == "null"
    assert got["scalar"]["yaml_structure"]["length"] == 5
    assert got["several"]["yaml_valid"] is False and got["broken"]["yaml_error"]
    assert got["loop"]["yaml_valid"] is None
    assert got["shared"]["yaml_depth"] == 3
    assert got["keys"]["yaml_root_keys"] == ["1", "False"]
