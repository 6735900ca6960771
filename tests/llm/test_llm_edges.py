"""Nulls, empty and very long texts, repeated rows, ties, empty tables and clashing column names, for every operator."""

import pytest

from sparsefold.llm import chat_format, fingerprints, html_extract, mixing, packing, quality_rules, sharding, simhash, token_counts, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row long, shard int, `__row` string, size string, row string"
LONG = "word " * 30_000


def docs(spark, empty=False):
    rows = [(1, "a b c d e f"), (2, None), (3, ""), (None, "a b c d e f"), (4, LONG), (5, "x"), (5, "x"), (5, "y"), (6, " \t\n "), (7, "é漢🙂 ß"), (None, None)]
    return spark.createDataFrame([] if empty else [(i, t, "en", "s" if t else None, 0, 9, 8, "r", "z", "w") for i, t in rows], DOCS)


def pages(spark, empty=False):
    rows = [(1, "u", "<p>x</p>"), (2, None, None), (None, "v", ""), (1, "u", "<p>x</p>"), (3, "w", "<div" * 50_000), (4, "x", "no markup & more")]
    return spark.createDataFrame([] if empty else [(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, _row int")


def turns(spark, empty=False):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "bot", ""), (2, 0, "system", "s" * 100_000), (3, 5, "tool", "<|im_end|>")]
    return spark.createDataFrame([] if empty else [(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq int")


def cases(spark, empty):
    d, p, t = docs(spark, empty), pages(spark, empty), turns(spark, empty)
    return {
        "html_extract": (html_extract.main_texts(p, training_pages=80), p),
        "quality_report": (quality_rules.quality_report(d), d),
        "sharding": (sharding.feistel_shards(d), d),
        "fingerprints": (fingerprints.fingerprints(d), d),
        "simhash": (simhash.near_duplicates(d), d),
        "token_counts": (token_counts.token_counts(d), d),
        "chat_format": (chat_format.repair(t), t),
        "mixing": (mixing.schedule(d), None),
        "packing": (packing.pack(d), None),
    }


@pytest.mark.parametrize("empty", [False, True])
def test_every_row_has_its_result(spark, empty):
    for name, (found, source) in cases(spark, empty).items():
        n = found.count()
        if source is not None:
            assert n == source.count(), name
        else:
            assert (n == 0) == empty, name


@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_the_columns(spark, empty):
    d = docs(spark, empty)
    for stage in (quality_rules.quality_filter, simhash.near_dedup, mixing.mix):
        out = stage(d)
        assert out.columns == d.columns and (out.count() == 0 or not empty)


@pytest.mark.parametrize("empty", [False, True])
def test_archives(spark, tmp_path, empty):
    p = pages(spark, empty)
    warc.write_archives(p, str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == p.count()


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs(spark, True).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_values_of_odd_rows(spark):
    """What null texts, null ids, wordless and repeated rows come to, row by row."""
    import hashlib
    import zlib

    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    rows = [(r["doc_id"], r["text"]) for r in docs(spark).collect()]
    d = docs(spark)
    words = [(i, (t or "").split()) for i, t in rows]
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["base_failed"], r["kept"]) for r in quality_rules.quality_report(d).collect()), key=str)
    assert got == sorted(((i, len(w), sum(map(len, w)), True, False) for i, w in words), key=str)  # few words, or one repeated
    shards = sharding.feistel_shards(d, shards=4).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in shards) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    held = [sorted(r["slot"] for r in shards if r["shard"] == k) for k in range(4)]
    assert sorted(map(len, held)) == [2, 3, 3, 3] and all(s == list(range(len(s))) for s in held)
    near = simhash.near_duplicates(d).collect()
    roots = {}
    for r in near:
        roots.setdefault(r["_root"], []).append(r)
    by_text = {}
    for i, t in rows:
        by_text.setdefault(" ".join((t or "").lower().split()), []).append(i)
    assert sorted(str(sorted(map(str, (r["_id"] for r in g)))) for g in roots.values()) == sorted(str(sorted(map(str, g))) for g in by_text.values())
    assert all(r["_print"] == 0 for r in near if r["_id"] in (2, 3, 6))
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(d).collect()) == sorted((str(i), len((t or "").encode()), len(lib.encode(t or ""))) for i, t in rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = sorted((str(i), len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    pieces = packing.pack(d).collect()
    whole = {}
    for r in pieces:
        whole.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append(r["length"])
    assert sorted((k, sum(v)) for k, v in whole.items()) == sorted(((i, n), n * sizes.count((i, n))) for i, n in set(sizes))
    kept = sorted(str(r["doc_id"]) for r in simhash.near_dedup(d).collect())
    assert kept == sorted(str(min((i for i in g if i is not None), default=None)) for g in by_text.values())
    assert {str(r["id"]) for r in mixing.schedule(d).collect()} == {str(i) for i, _ in rows}
    p = {(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.main_texts(pages(spark), training_pages=80).collect() if r["page_id"] in (None, 2)}
    assert p == {(None, "", 0), (2, "", 0)}
    assert hashlib.sha256(b"").hexdigest() in {r["payload_digest"] for r in _read_back(spark)}


def _read_back(spark):
    import tempfile

    path = tempfile.mkdtemp(prefix="sparsefold-edges-") + "/w"
    warc.write_archives(pages(spark), path)
    return warc.read_archives(spark, path).collect()


def test_new_operators_count_every_row(spark):
    from sparsefold.llm import alignment, credentials, merkle

    for empty in (False, True):
        d = docs(spark, empty)
        n = d.count()
        assert merkle.manifest(d)[0].count() == credentials.credential_links(d).count() == alignment.align(d)[0].count() == n
