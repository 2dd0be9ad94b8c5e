"""The pipeline against a brute-force version of each stage, and the guard around it."""

import collections
import hashlib

import corpus_pipeline
from test_operators import WORD, components, labelled, shingles

from pagewright.llm import bpe, pii, quality_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_mix(docs):
    """Times that each document is taken, straight from the definition."""
    size = {r.doc_id: len(WORD.findall(r.text)) for r in docs}
    total = collections.Counter()
    for r in docs:
        total[r.source] += size[r.doc_id]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(total))}
    target, free = {}, set(total)
    while True:
        left = 1.5 * sum(total.values()) - sum(target.values())
        level = left / sum(weight[s] for s in free) if free else 0
        full = {s for s in free if level * weight[s] > 2 * total[s]}
        if not full:
            break
        target |= {s: 2.0 * total[s] for s in full}
        free -= full
    target |= {s: level * weight[s] for s in free}
    offers = []
    for s in total:
        mine = sorted((r.doc_id for r in docs if r.source == s), key=lambda d: (hashlib.md5(f"{d}mix-1".encode()).hexdigest(), d))
        upto = 0
        for lap in range(2):
            for d in mine:
                upto += size[d]
                if size[d]:
                    offers.append((upto / target[s], d))
    times, used = collections.Counter(), 0
    for _, d in sorted(offers):
        used += size[d]
        if used > 1.5 * sum(total.values()):
            break
        times[d] += 1
    return times


def test_pipeline(spark, tmp_path):
    docs, labels = labelled(spark, 300)
    docs = docs.selectExpr("doc_id", "concat(text, ' mail a', doc_id % 3, 'b.c@x.example.com') as text", "lang", "concat('s', doc_id % 4) as source", "cast(0 as long) as n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    now, kept = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        before, now = now.collect(), spark.read.parquet(str(tmp_path / f"stage{k}"))
        after = now.collect()
        kept[name] = after
        if k < 4:
            assert now.columns == COLUMNS
        if k == 0:
            model = quality_model.train(docs, labels)
            good = {r.doc_id for r in quality_model.score_quality(docs, model).collect() if r.score >= 0.3}
            assert {r.doc_id for r in after} == good and len(good) < len(before)
        elif k == 1:
            groups = components({r.doc_id: shingles(r.text) for r in before})
            assert {r.doc_id for r in after} == set(groups.values()) and len(after) < len(before)
        elif k == 2:
            f = pii.Feistel(pii.DEMO_KEY)
            want = {r.doc_id: pii.find_and_replace(r.text, f)[0] for r in before}
            assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
        elif k == 3:
            assert collections.Counter(r.doc_id for r in after) == plain_mix(before)
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(bpe.default_path())
            texts = {r.doc_id: r.text for r in before}
            assert len(after) == len(before) and all(r.tokens == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in after)

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.ids_sha256) for r in whole) == collections.Counter((r.doc_id, r.ids_sha256) for r in kept["BPE encoding and decoding"])


def test_pipeline_on_empty_and_odd_tables(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some text without id " * 9, "en", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "odd/documents.parquet"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "none/documents.parquet"))
    for name in ("odd", "none"):
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / f"{name}/labels.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()} == {None}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
