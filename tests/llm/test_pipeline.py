import duckdb
import public_tokenizers
import sentencepiece
from test_similar import kept as first_of_each

import corpus_pipeline
from zonalis.llm import common, decontaminate, language, pii, simhash

SF = "/root/testdata/sf0.001"


def plain(net, docs, items, field):
    """The same decisions, one document after the other."""
    kept = [(i, t) for i, t in docs if t and any(map(str.isalpha, t)) and net.pooled(*common.buffers(__import__("pyarrow").array([t]))).max() >= 0.5]
    stay = set(first_of_each(kept))  # five-word sets, Jaccard similarity of 0.8 or more, all pairs
    first = {i: (i, t) for i, t in kept if i in stay}
    out = []
    for i, t in first.values():
        w = t.lower().split() if t.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()
        bad = False
        for x in items:
            a = "".join(c.lower() if "A" <= c <= "Z" else c for c in x).split()
            if len(a) >= 5 and set(zip(*(a[k:] for k in range(5)))) & set(zip(*(w[k:] for k in range(5)))):
                code = {s: k for k, s in enumerate({*a, *w})}
                got = decontaminate.tiles([code[s] for s in a], [code[s] for s in w])
                bad = bad or sum(g[2] for g in got) >= 0.8 * len(a)
        if not bad:
            out.append((i, pii.mask(t, pii.find(t, field)[1])))
    return sorted(out)


def test_whole_table_against_the_plain_version(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = [r[0] for r in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    net = language.learn(common.table(spark, SF, "documents"))
    want = plain(net, docs, items, pii.train())
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_pieces", "pieces"]
    rows = sorted(got.collect())
    assert [(r.doc_id, r.text) for r in rows] == want and 0 < len(rows) < len(docs)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r.pieces == lib.encode(r.text) and r.n_pieces == len(r.pieces) and r.n_chars == len(r.text) for r in rows)


def test_stages_on_odd_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    schema = base.schema
    some = base.orderBy("doc_id").limit(3).collect()
    odd = spark.createDataFrame([tuple(r) for r in some] + [tuple(some[0]), (None, None, None, None, None), (None, some[1].text, "x", "y", 1), (7_000, "", "x", "y", 0), (7_001, "12 34", None, None, 5), (some[2].doc_id, "another text the of and to is was", "en", "s", 3)], schema)
    for frame in (odd, odd.limit(0)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            before = docs.count()
            docs = common.materialize(stage(spark, docs, SF))
            assert docs.columns[:5] == base.columns and docs.count() <= before, name
    one = simhash.one_of_each(odd)
    got = sorted((r.doc_id, r.text) for r in one.collect() if r.text and r.doc_id is not None and r.doc_id < 7_000)
    assert got == sorted({(r.doc_id, r.text) for r in some} | {(some[2].doc_id, "another text the of and to is was")})
    assert one.count() == one.distinct().count()


def test_only_written_tables_are_discarded(spark, tmp_path):
    mine = str(tmp_path / "zonalis" / "mine")
    spark.range(3).write.parquet(mine)
    table = common.materialize(spark.read.parquet(mine))
    common.discard(spark.read.parquet(mine))
    assert spark.read.parquet(mine).count() == 3 == table.count()
    (folder,) = {f.rpartition("/")[0].removeprefix("file://") for f in table.inputFiles()}
    common.discard(table)
    import os

    assert not os.path.exists(folder)
