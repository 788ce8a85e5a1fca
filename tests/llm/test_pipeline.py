import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from kalends.llm.near_dup import aligned, windows
from tests.llm.test_near_dup import edited, prose
from tests.llm.test_pii import base as pii_base
from tests.llm.test_quality import base as quality_base


def test_stages_one_after_another(spark, tmp_path):
    rng = random.Random(11)
    good = [prose(rng, 60) for _ in range(10)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(good)]
    line = prose(rng, 20)
    rows += [(20, good[0], "en", "s0"), (21, edited(rng, good[1], 1), "en", "s1"), (22, "too short", "en", "s1"), (23, "a b c d e " * 30, "en", "s1"), (24, None, None, None)]
    rows += [(25, prose(rng, 40) + "\n" + line, "fr", "s2"), (26, prose(rng, 40) + "\n" + line, "fr", "s2"), (27, prose(rng, 30) + " mail bob.lee@x.example.com now or +1 (555) 123-4567 " + prose(rng, 30), "de", "s0")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t) if t else None) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = out.collect()
        out = stage(spark, out, str(tmp_path))
        seen[name] = (before, out.collect())
        if name != "packing":
            assert out.columns == docs.columns
        out = spark.createDataFrame(seen[name][1], out.schema)
    ids = {k: {r.doc_id: r for r in v[1]} for k, v in seen.items()}
    # rows that the base rules fail go; these texts are in one made-up language, so none is far from it
    assert set(ids["quality"]) == {i for i, t, _, _ in rows if not quality_base(t)[5]}
    removed = {r.doc_id for r in seen["line_dedup"][0]} and {i for i, r in ids["line_dedup"].items() if r.text != ids["quality"][i].text}
    assert removed == {20, 21, 26} and ids["line_dedup"][20].text == "" and line not in ids["line_dedup"][26].text
    assert all(r.n_chars == len(r.text) for r in ids["line_dedup"].values())
    texts = {i: r.text for i, r in ids["line_dedup"].items()}
    gone = {i for i in texts for j in texts if j < i and (texts[i] == texts[j] or aligned(windows(texts[i]), windows(texts[j])) >= 0.8)}
    assert set(ids["near_dedup"]) == set(texts) - gone
    for i, r in ids["pii"].items():
        assert not pii_base(r.text)
        assert re.sub(r"\[(EMAIL|PHONE)\]", "", r.text) == r.text or i == 27
    assert "[EMAIL]" in ids["pii"][27].text and "[PHONE]" in ids["pii"][27].text
    assert {r.doc_id for r in seen["packing"][1]} == set(ids["pii"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, whole)) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in seen["packing"][1])


def test_columns_that_clash_stay(spark):
    rows = [(1, "the same line of a text\nanother line here", "en"), (2, "the same line of a text\nmail a.b@c.de now", "en"), (3, None, None), (4, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("own", "_own", "doc", "of", "gone", "n_lines", "N_Removed", "quality", "pii", "base", "spans", "m", "h", "t", "n"):
        docs = docs.withColumn(name, F.lit(f"{name} stays"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c} stays" for c in docs.columns[3:]), name
