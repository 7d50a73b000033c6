"""The stages of the pipeline on a small corpus with planted cases."""

import random

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackgrid.llm import decontamination, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item, passage = prose(25), prose(51)
    assert 240 <= len(passage) < 400
    texts = [prose(rng.randint(5, 150)) for _ in range(150)]
    toxic = list(range(150, 210))
    texts += [prose(40) + " nastyword " + prose(10) + " vileword" for _ in toxic]
    copies = {210: 0, 211: 1, 212: 1}
    texts += [texts[0], texts[1], texts[1]]
    texts += [prose(10) + " " + item + " " + prose(9)]  # 213
    texts += [prose(30) + " " + passage + " " + prose(20) for _ in range(3)]  # 214-216
    texts += ["", None]
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(0, 205)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, set(toxic), copies, passage


def test_stages(spark, folder):
    path, texts, toxic, copies, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_substrings", "decontamination", "packing"]
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    everything = set(range(len(texts)))
    mild = steps["toxicity"](spark, docs, path)
    assert mild.columns == COLUMNS and ids(mild) == everything - toxic
    single = steps["near_duplicates"](spark, mild, path)
    assert single.columns == COLUMNS and ids(single) == everything - toxic - set(copies) - {len(texts) - 1}
    cut = steps["repeated_substrings"](spark, single, path)
    assert cut.columns == COLUMNS and cut.count() == single.count()
    for r in cut.collect():
        if r["doc_id"] in (214, 215, 216):
            assert passage not in r["text"] and len(r["text"]) < len(texts[r["doc_id"]]) - len(passage) + 20
        else:
            assert r["text"] == texts[r["doc_id"]]
    clean = steps["decontamination"](spark, cut, path)
    assert clean.columns == COLUMNS and ids(clean) == ids(cut) - {213}
    packed = steps["packing"](spark, clean, path).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    total = sum(len(encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in clean.collect())
    assert sum(r["length"] for r in packed) == total
    assert len({r["sequence_id"] for r in packed}) == -(-total // 1024)
    whole = corpus_pipeline.run(spark, path).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, packed))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, folder, name):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, folder[0]).count() == 0


def test_clashing_columns(spark, folder):
    """Every stage but the last hands on columns of any names and their values."""
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    extra = ["_x", "_score", "_found", "_d", "_n", "x", "row", "id", "found", "k", "n", "root", "none", "among", "bucket", "bitmap"]
    wide = docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in extra})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, path)
        assert out.columns == wide.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in extra), name


def test_one_text_of_each_chain_of_short_ones_stays(spark):
    """Ten shingles, of which each text shares nine with the next: the links that are no text's best one count, too."""
    rng = random.Random(3)
    texts = []
    for _ in range(8):
        w = [f"w{rng.randrange(10**9)}" for _ in range(164)]
        texts += [" ".join(w[i : i + 14]) for i in range(150)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert corpus_pipeline.drop_near_duplicates(spark, docs, "").count() == 8


def test_odd_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (None, None, "z"), (None, None, None), (2, None, "w"), (3, "d e", "v"), (None, "a  b C", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.deduplicated(docs).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, "a b c"), (2, None), (3, "d e")]
    items = spark.createDataFrame([(7, "D e"), (8, "q " * 40), (9, "zz yy " * 30)], "item_id long, text string")
    for item_bytes in (1 << 20, 50):
        clean = decontamination.clean(docs, items, 10, item_bytes)
        assert clean.columns == docs.columns and clean.count() == 6
