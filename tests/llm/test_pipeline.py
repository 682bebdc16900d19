"""The pipeline's stages against plain versions of what they decide."""

import re

import corpus_pipeline
import public_tokenizers
from test_operators import brute_similar, check_packing, plain_spans
from tokenizers import Tokenizer

from rowmill.llm import quality
from rowmill.llm.common import materialize

SF = "/root/testdata/sf0.01"


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_filter", "exact_copies", "near_copies", "mask_secrets", "pack"]
    texts = lambda df: dict(df.select("doc_id", "text").collect())

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    one = materialize(steps["quality_filter"](spark, docs, SF), "t")
    assert one.columns == columns
    scored = quality.score(docs, quality.train(docs, labels))
    assert set(texts(one)) == {r["doc_id"] for r in scored.where("score >= 0.7").collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()} & set(texts(docs))
    assert len(good & set(texts(one))) > 0.98 * len(good)

    two = materialize(steps["exact_copies"](spark, one, SF), "t")
    best = {}
    for i, t in texts(one).items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(t), i))
    assert two.columns == columns and set(texts(two)) == {i for _, i in best.values()}

    three = materialize(steps["near_copies"](spark, two, SF), "t")
    assert three.columns == columns and set(texts(three)) == set(brute_similar(texts(two))[1].values())

    four = materialize(steps["mask_secrets"](spark, three, SF), "t")
    before, after = texts(three), texts(four)
    assert four.columns == columns and set(before) == set(after)
    for i, t in before.items():
        spans = plain_spans(t)
        if not spans and "[SECRET]" not in after[i]:
            assert after[i] == t
        for _, a, b in spans:
            assert t[a:b] not in after[i]

    five = steps["pack"](spark, four, SF).collect()
    n = check_packing(five, after, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert n <= -(-sum(r["length"] for r in five) // 2048) + 1
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in five)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score string, Predicted int, _digest string, row_key long, rid string, node int, component long, key string, kept boolean, group long"
BASE = "the committee met on monday and agreed that the new road should be built along the river bank before winter"
AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t"),
    (4, BASE + " as planned by the council in the spring of last year when the work was first proposed to them all"),
    (4, BASE + " as planned by the council in the spring of last year when the work was first proposed to them all"),
    (5, BASE + "  as planned by the council in the spring of last year when the work was first proposed to them all"),
    (6, BASE + " as planned by the council in the spring of last year when the work was first proposed to them both"),
    (None, BASE + " as planned by the council in the spring of last year when the work was first proposed to them again"),
    (None, None),
    (7, 'the key is password = "hunter22abc" and 0123456789abcdef0123456789abcdef as told ' + BASE[::-1]),
    (8, "x" * 300_000),
    (9, ("one two three four five six seven eight nine ten " + BASE + " ") * 9_000),
]


def awkward_table(spark):
    rows = [(i, t, "en", None, None, f"s{k}", k, "d", k, "r", 1, 2, "k", None, 3) for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, CLASHING).repartition(3)


def test_stages_on_an_awkward_table(spark):
    """Nulls, empty and very long texts, repeated rows and ids, null ids, and columns of the names that operators use inside."""
    steps = dict(corpus_pipeline.STAGES)
    docs = materialize(awkward_table(spark), "t")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = sorted(r["_digest"] + str(r["row_key"]) for r in quality.score(docs, model).where("predicted = 1").collect())
    one = steps["quality_filter"](spark, docs, SF)
    assert one.columns == docs.columns and sorted(r["_digest"] + str(r["row_key"]) for r in one.collect()) == want

    two = materialize(steps["exact_copies"](spark, docs, SF), "t")
    assert two.columns == docs.columns and two.schema == docs.schema
    keep = {(i, t) for i, t in ((r["doc_id"], r["text"]) for r in two.collect())}
    assert two.count() == len(keep) == 7 and {i for i, _ in keep} == {3, 5, 6, None, 7, 8, 9}  # the longest blank text, and the copy with one more space

    three = materialize(steps["near_copies"](spark, docs, SF), "t")
    got = sorted((r["doc_id"] or 0) for r in three.collect())
    assert three.columns == docs.columns and got == [0, 1, 2, 3, 4, 7, 8, 9]  # one of the two rows 4 stands for 4, 5, 6 and the row without an id

    four = materialize(steps["mask_secrets"](spark, docs, SF), "t")
    texts = {r["row_key"]: r["text"] for r in four.collect()}
    assert four.columns == docs.columns and len(texts) == len(AWKWARD) and texts[0] is None
    assert "hunter22abc" not in texts[9] and "0123456789abcdef" not in texts[9] and texts[11] == AWKWARD[11][1]

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    five = steps["pack"](spark, docs, SF).collect()
    assert sum(r["length"] for r in five) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in AWKWARD)


def test_stages_on_an_empty_table(spark):
    docs = awkward_table(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, materialize(docs, "t"), SF)
        assert out.count() == 0 and (name == "pack" or out.columns == docs.columns), name
