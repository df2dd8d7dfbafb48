from __future__ import annotations

import hashlib
import shutil
import sys
from pathlib import Path

import corpus_pipeline
import numpy as np
from relata.llm import minhash, pii, quality
from relata.llm.queries import oracle_sql, table, tokenizer_path

sys.path.insert(0, str(Path(__file__).resolve().parent))


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "decontamination", "pii_surrogates", "bpe_encoding"]
    first = stages["quality_rules"](spark, docs, sf)
    assert first.columns == corpus_pipeline.DOCUMENT_COLUMNS
    assert ids(first) == ids(quality.quality_rules(docs).where("kept"))
    second = stages["near_duplicates"](spark, first, sf)
    assert ids(second) == ids(minhash.near_duplicates(first).where("kept"))
    third = stages["decontamination"](spark, second, sf)
    assert ids(third) <= ids(second)
    fourth = stages["pii_surrogates"](spark, third, sf)
    assert ids(fourth) == ids(third)
    assert fourth.where("n_chars <> length(text)").count() == 0
    last = corpus_pipeline.run(spark, sf)
    assert ids(last) == ids(fourth)
    assert last.where("n_tokens * 4 <> length(ids)").count() == 0


def _clean(texts: dict, items: list[str]) -> set:
    """Ids of the texts that the contract's rule doesn't call contaminated."""
    from test_operators import lettered

    grams = {n: set() for n in range(1, 14)}
    for t in map(lettered, items):
        n = min(13, len(t))
        if n:
            grams[n] |= {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
    out = set()
    for i, text in texts.items():
        w, hit = lettered(text), set()
        for n, own in grams.items():
            for k in range(len(w) - n + 1) if own else ():
                if tuple(w[k : k + n]) in own:
                    hit |= set(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            out.add(i)
    return out


def test_run_against_plain_python(spark, sf, tmp_path):
    """run()'s rows, held against SQL, brute force and the tokenizers library; and clean documents stay."""
    import duckdb
    import regex
    from test_operators import components_of
    from tokenizers import Tokenizer

    benchmark = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.DOCUMENT_COLUMNS)
    base = [r for r in docs.collect() if r.text and len(r.text.split()) > 150][:12]
    mail = "jo.planted@mail.example.com"
    planted = [(10_000 + k, f"{r.text} {['', mail, benchmark[0]][k % 3]} the end {k}") for k, r in enumerate(base)] + [(20_000, None), (20_001, ""), (None, "a null id")]
    more = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in planted], docs.schema)
    docs.unionByName(more).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{sf}/benchmark.parquet", tmp_path / "benchmark.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    texts = dict(c.sql("SELECT doc_id, coalesce(text, '') FROM documents WHERE doc_id IS NOT NULL").fetchall())
    good = {i for i, kept in c.sql(f"SELECT doc_id, kept FROM ({oracle_sql()['op2_quality_rules']})").fetchall() if kept}
    single = {i: t for i, t in texts.items() if i in good}
    single = {i: single[i] for i, (_, _, kept) in components_of(single).items() if kept}
    left = _clean(single, benchmark)
    assert 0 < len(left) < len(single) < len(good) < len(texts)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got.keys() == left
    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    found = regex.compile(pii.PATTERN.replace("\\p{IsCyrillic}", "\\p{Cyrillic}"))
    changed = 0
    for i, r in got.items():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(r.ids).hexdigest())
        assert hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest() == r.decoded_sha256
        want = library.encode(texts[i], add_special_tokens=False).ids
        if found.search(texts[i]):
            changed += ids != want
            assert library.encode(mail, add_special_tokens=False).ids != ids[-10:]
            assert "planted" not in library.decode(ids, skip_special_tokens=False).replace(" ", "")
        else:
            assert ids == want
    assert changed


def test_odd_and_empty_tables(spark, sf, odd):
    from pyspark.sql import functions as F

    docs = odd.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    for start in (docs, docs.limit(0)):
        df, rows = start, None
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, sf)
            now = df.count()
            assert rows is None or now <= rows
            assert name not in ("pii_surrogates", "bpe_encoding") or now == rows
            rows = now
            if name != "bpe_encoding":
                assert df.columns == corpus_pipeline.DOCUMENT_COLUMNS
                assert df.where("text IS NULL").count() == 0  # rejected by the first stage
        assert {"doc_id", "n_tokens", "ids_sha256"} <= set(df.columns)
        assert start is docs or rows == 0
