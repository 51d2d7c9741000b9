"""Fill-in-middle: descriptors, forms, exact round trips."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import fill_middle as fim

from . import brute

HARD = ["", "\n", "\n\n", "a", "a\n", "a\nb", "é\n日本\n\nx", "<", "<P", "<S\n<S", "a <P> b\nc", "x\n<M>", "M>\n<S", None,
        "line\n" * 500, "no line end " * 2000]


def plain_version(doc_id, text, rate=100, spm=50, seed="7"):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 100), (0, 50)])
def test_forms_and_outputs_equal_the_plain_version(spark, rate, spm):
    rows = brute.EDGES + [(100 + i, t) for i, t in enumerate(HARD)] + [(i, "one\ntwo\nthree\nfour\n") for i in range(200, 260)]
    made = fim.transform(brute.frame(spark, rows), rate=rate, spm=spm, keep=["doc_id", "text"])
    got = fim.restore(made, keep=["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256",
                                  "pieces"]).collect()
    assert len(got) == len(rows)
    for r in got:
        n, form, p, m, output = plain_version(r["doc_id"], r["text"], rate, spm)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == (n, form, p, m, output)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored"] == (r["text"] or "")
        assert r["restored_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        buffers = ((r["text"] or "").encode(), fim.SENTINELS)
        assert b"".join(buffers[x["buffer"]][x["start"]:x["start"] + x["length"]] for x in r["pieces"]).decode() == output


def test_all_forms_occur(spark):
    made = fim.transform(brute.frame(spark, [(i, "a\nb\nc") for i in range(100)]))
    assert {r["form"] for r in made.collect()} == {"psm", "spm"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5), st.integers(1, 9)), max_size=6), st.integers(0, 60))
def test_cut_splits_without_loss(pieces, at):
    buffers = (bytes(range(20)), bytes(range(100, 120)))
    left, right = fim.cut(pieces, at)
    whole = b"".join(fim.stream(pieces, buffers))
    assert b"".join(fim.stream(left, buffers)) == whole[:at]
    assert b"".join(fim.stream(right, buffers)) == whole[at:]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("<PSM>ab\n", max_size=8).filter(lambda t: not re.search("<[PSM]>", t)), min_size=3, max_size=3),
       st.sampled_from(["psm", "spm"]))
def test_inverse_finds_the_parts_beside_broken_sentinels(parts, form):
    text = "".join(parts)
    if re.search("<[PSM]>", text):
        return
    raw = [p.encode() for p in parts]
    places = [0, len(raw[0]), len(raw[0]) + len(raw[1])]
    pieces = [[(fim.TEXT, s, len(p))] if p else [] for s, p in zip(places, raw, strict=True)]
    output = b"".join(fim.stream(fim.arrange(pieces, form), (text.encode(), fim.SENTINELS)))
    back = fim.inverse([(fim.TEXT, 0, len(output))], output, form)
    assert b"".join(fim.stream(back, (output,))).decode() == text


def test_clashing_and_empty_input(spark):
    docs = brute.frame(spark, [(1, "a")])
    with pytest.raises(ValueError, match="form"):
        fim.transform(docs.withColumnRenamed("lang", "form"), keep=["doc_id", "form"])
    with pytest.raises(ValueError, match="restored"):
        fim.restore(fim.transform(docs).withColumnRenamed("n", "restored"), keep=["doc_id", "restored"])
    assert fim.restore(fim.transform(brute.frame(spark, []))).count() == 0
    assert fim.transform(docs, keep=["doc_id", "source", "n_chars"]).columns[:3] == ["doc_id", "source", "n_chars"]
