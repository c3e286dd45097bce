import hashlib

import pytest

from textscore.llm import suffixes


def brute_force(texts: dict) -> dict:
    """n_bytes, n_removed, n_spans and what is left, by a set of all earlier strings."""
    seen, out = set(), {}
    for key in sorted(texts):
        raw = texts[key].encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - 99):
            window = raw[at:at + 100]
            if window in seen:
                gone[at:at + 100] = b"\x01" * 100
            seen.add(window)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[key] = (len(raw), sum(gone), spans, kept)
    return out


def results(frame) -> list:
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in frame.collect())


@pytest.mark.parametrize("small", [False, True])
def test_plain_rows_equal_brute_force(plain, monkeypatch, spark, small):
    """Small chunks and batches cut texts, runs and buckets at every turn."""
    if small:
        monkeypatch.setattr(suffixes, "CHUNK_BYTES", 700)
        monkeypatch.setattr(suffixes, "COLLAPSE_ROWS", 40)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        texts = {r["doc_id"]: r["text"] or "" for r in plain.collect()}
        expected = [(k, *v) for k, v in sorted(brute_force(texts).items())]
        got = suffixes.suffix_dedup(plain.repartition(5))
        assert results(got) == expected and sum(e[2] for e in expected) > 1000
        assert all(r["kept_sha256"] == hashlib.sha256(bytes(r["kept"])).hexdigest() for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_messy_rows_have_one_result_for_each_document(messy):
    rows = suffixes.suffix_dedup(messy).collect()
    assert len(rows) == messy.count()
    first = [r for r in rows if r["doc_id"] == 53]
    assert len(first) == 3 and len({tuple(r) for r in first}) == 1  # a repeated row is no repeat of itself
    assert all(r["n_removed"] == r["n_bytes"] for r in rows if r["doc_id"] is None)  # the null id comes last
    assert {r["n_bytes"] for r in rows if r["doc_id"] == 3} == {0}


def test_pipeline_form_keeps_columns(messy, nothing):
    cut = suffixes.without_repeats(messy)
    assert cut.columns == messy.columns and cut.dtypes == messy.dtypes
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[63] == "" and texts[3] == ""
    assert suffixes.without_repeats(nothing).count() == 0 and suffixes.suffix_dedup(nothing).count() == 0


def test_a_hot_passage_leaves_one_copy(spark):
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(130))
    rows = [(i, f"{i:07d} " * 20 + passage + f" {i * 31:09d}" * 15) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    expected = [(k, *v) for k, v in sorted(brute_force(dict(rows)).items())]
    assert results(suffixes.suffix_dedup(frame)) == expected


@pytest.mark.parametrize("first, last", [("é", "é"), ("ĩ", "è"), ("漢", "字"), ("𝄞", "𝄢"), ("a", "漢"), ("𝄞", "b")])
def test_no_character_is_made_of_two_halves(spark, first, last):
    shared = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(130))
    others = {2: ["é", "ĩ"], 3: ["漢", "漣"], 4: ["𝄞", "𝅘"], 1: ["a", "z"]}
    texts = [(1, first + shared + last)]
    for k, a in enumerate(others[len(first.encode())]):
        texts += [(10 + 10 * k + m, a + shared + b) for m, b in enumerate(others[len(last.encode())] + [last])]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffixes.without_repeats(rows).collect()}
    assert got[1] == texts[0][1]
    for i, text in texts[1:]:
        assert set(got[i]) <= {text[0], text[-1]} and len(got[i]) <= 2
