import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from fluxframe.llm import bpe

FILE = public_tokenizers.path("word_bpe_49k.json")


def check(docs, rows):
    tokenizer = Tokenizer.from_file(FILE)
    expected = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        expected.append((doc, len(ids), np.array(ids, "<u4").tobytes(),
                         tokenizer.decode(ids, skip_special_tokens=False)))
    encoded = bpe.encode(docs, FILE)
    got = bpe.decode(encoded.withColumn("kept", F.col("ids")), FILE).select("doc_id", "n_tokens", "kept", "decoded")
    assert sorted(((a, b, bytes(c), d) for a, b, c, d in got.collect()), key=str) == sorted(expected, key=str)


def test_odd_rows(odd, odd_rows, empty):
    check(odd, [r[:2] for r in odd_rows])
    assert bpe.encode(empty, FILE).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_other_scripts_and_special_tokens(spark):
    rng = random.Random(3)
    ranges = ((32, 126), (160, 591), (880, 1023), (1024, 1279), (0x4E00, 0x4FFF), (0x1F600, 0x1F64F), (0x300, 0x36F))
    texts = ["".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += ["aaa", "aaaa", "a" * 3000, "abab" * 500, "<|endoftext|><|startoftext|>x<|", "can't WON'T 'S 'll"]
    rows = list(enumerate(texts))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_more_words_than_are_remembered(spark, sf, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    monkeypatch.setattr(bpe, "STRETCH_BYTES", 100)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_decoding_keeps_null_and_other_columns(spark):
    rows = [(1, None, "a"), (2, b"", "b"), (3, np.array([49406, 320, 49407], "<u4").tobytes(), "c")]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids binary, other string"), FILE).collect()
    assert sorted(map(tuple, got)) == [(1, "a", None), (2, "b", ""), (3, "c", "<|startoftext|> a</w> <|endoftext|>")]
