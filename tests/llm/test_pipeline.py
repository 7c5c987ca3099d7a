"""The pipeline's stages on a small corpus with planted cases."""

import numpy as np

import corpus_pipeline


def test_stages(spark, tmp_path):
    random = np.random.default_rng(1)
    text = lambda n: " ".join(f"w{x}" for x in random.integers(0, 5000, n))
    clean = [(i, text(40)) for i in range(60)]
    toxic = [(i, text(20) + " worthless idiot moron scum " + text(10)) for i in range(60, 90)]
    copies = [(100, clean[0][1]), (101, clean[1][1])]
    near = [(110, clean[2][1] + " tail"), (111, clean[3][1] + " other tail")]
    secret = [(120, text(20) + " token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" " + text(5))]
    rows = [(i, t, "en", "s", len(t)) for i, t in clean + toxic + copies + near + secret]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert out.columns == docs.columns
            docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
            kept[name] = {r.doc_id for r in docs.collect()}
    everything = {r[0] for r in rows}
    assert kept["toxicity"] == everything - {i for i, _ in toxic}
    assert kept["exact dedup"] == kept["toxicity"] - {0, 1}
    assert kept["n-gram Jaccard join"] == kept["exact dedup"] - {110, 111}
    assert kept["secret scans"] == kept["n-gram Jaccard join"]
    masked = docs.where("doc_id = 120").first()
    assert "[SECRET]" in masked.text and "04dbebab" not in masked.text and masked.n_chars == len(masked.text)
    assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "stage4")).collect()} == kept["secret scans"]
