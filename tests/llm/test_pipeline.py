"""The corpus pipeline against plain Python."""
import corpus_pipeline as cp
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lanewise.llm import order_minhash as om

SF = "/root/testdata/sf0.001"


def test_stages_and_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(90001, None, None, None, None), (90002, "12 34 ...", "en", "s", 9), (90003, "", None, "s", 0), (None, "the house and the water were here", "en", None, 33),
             (90004, "the house was of a different age and password=e3b3ed3cc8548923d6 they said again", "en", "s", 80)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    kept = [docs]
    for name, stage in cp.STAGES[:-1]:
        kept.append(cp.saved(stage(spark, kept[-1], SF)))
        assert kept[-1].columns == docs.columns, name
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert ids[0] - ids[1] == {90001, 90002, 90003}
    groups = {r.doc_id: r.component_id for r in om.near_duplicates(kept[1]).collect() if r.doc_id is not None}
    assert ids[2] - {None} == set(groups.values()) and ids[3] == ids[2] and None in ids[3]
    texts = {r.doc_id: r.text for r in kept[3].collect()}
    assert "password=[SECRET] they" in texts[90004] and all(texts[i] == t for i, t in ((r.doc_id, r.text) for r in kept[2].collect()) if "[SECRET]" not in texts[i])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = cp.STAGES[-1][1](spark, kept[3], SF).collect()
    sizes = {}
    for r in rows:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert np.ptp([r.sequence_id for r in rows]) + 1 == -(-sum(sizes.values()) // 1024)


def test_run_gives_the_last_stage(spark):
    assert cp.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window"]
    assert cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES] == ["language", "near copies", "secrets", "packing"]
