import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_samples import prose
from pyspark.sql import functions as F

from shelfmark.llm.fill_in_middle import digests, exchange, fill_in_middle, rearrange, restore, restore_texts

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text, seed=42, plain=50, spm=80):
    """(n, form, prefix_chars, middle_chars, output) by slicing lists of units."""
    text = text or ""
    units = UNIT.findall(text)
    name = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(name[i : i + 8], 16) for i in range(0, 32, 8)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= plain:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.binary(max_size=40), st.integers(0, 40), st.integers(0, 40))
def test_neighbours_change_places(data, a, b):
    a, b = sorted((min(a, len(data)), min(b, len(data))))
    block = bytearray(data)
    exchange(block, a, b, len(block))
    assert bytes(block) == data[:a] + data[b:] + data[a:b]


@settings(max_examples=300)
@given(st.text(alphabet="<>PSM aé", max_size=30), st.data(), st.sampled_from(["plain", "psm", "spm"]))
def test_every_text_is_rebuilt(text, data, form):
    body = re.sub("<[PSM]>", "", re.sub("<[PSM]>", "", text)).encode()
    if any(s in body for s in (b"<P>", b"<S>", b"<M>")):
        return
    first = data.draw(st.integers(0, len(body)))
    second = data.draw(st.integers(first, len(body)))
    made = bytes(rearrange(body, first, second, form))
    assert bytes(restore(made, form)) == body
    p, m, s = body[:first], body[first:second], body[second:]
    wanted = {"plain": body, "psm": b"<P>" + p + b"<S>" + s + b"<M>" + m, "spm": b"<S>" + s + b"<P>" + p + b"<M>" + m}
    assert made == wanted[form]


def test_rows_of_every_kind(spark, edge):
    more = [
        (300 + i, t)
        for i, t in enumerate(["a <P> b", " x<M>", "<S>", "  lead", "tail \n", "é ß x", "\t", "a" * 2_500_000, "<", "< P>"] * 4)
    ]
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = docs.collect()
    got = sorted(map(tuple, fill_in_middle(docs).collect()), key=str)
    assert got == sorted(((r["doc_id"], *brute(r["doc_id"], r["text"])) for r in rows), key=str)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    back = restore_texts(fill_in_middle(docs)).collect()
    assert sorted(((r["doc_id"], r["restored"]) for r in back), key=str) == sorted(
        ((r["doc_id"], r["text"] or "") for r in rows), key=str
    )
    shown = digests(fill_in_middle(docs)).filter(F.col("form") == "psm").first()
    assert shown["restored_sha256"] != shown["output_sha256"]


def test_extra_columns_may_have_any_name(spark):
    docs = spark.createDataFrame(
        [(1, prose(1, 20), "x", "y", 3)], "doc_id long, text string, form string, output string, n long"
    )
    assert tuple(fill_in_middle(docs, plain_percent=100).first()) == (1, *brute(1, prose(1, 20), plain=100))


def test_parameters_and_other_keys(spark):
    docs = spark.createDataFrame([("k1", prose(1, 20)), ("k2", prose(2, 9)), (None, "a b")], "name string, body string")
    got = fill_in_middle(docs, key="name", text="body", seed=7, plain_percent=100, spm_percent=0).collect()
    assert {r["form"] for r in got} == {"psm"}
    assert sorted(map(tuple, got), key=str) == sorted(
        ((r["name"], *brute(r["name"], r["body"], 7, 100, 0)) for r in docs.collect()), key=str
    )


def test_null_output_and_unknown_form(spark):
    made = spark.createDataFrame([(None, "psm"), ("a<P>", None), ("b", "other")], "output string, form string")
    assert [r["restored"] for r in restore_texts(made).collect()] == [None, "a<P>", "b"]


def test_empty_table(nothing):
    result = digests(fill_in_middle(nothing))
    assert result.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert result.count() == 0
