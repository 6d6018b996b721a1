from collections import Counter

import zstandard
from fluxframe.llm import compression

WHITE = " \t\n\x0b\x0c\r"


def slow_counts(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in WHITE:
            words += [word] if word else []
            word = ""
        else:
            word += c
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            repeats += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeats, len(covered))


def slow_row(text, rules):
    counts = slow_counts(text)
    failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
    raw = (text or "").encode()
    verdict = "empty"
    if raw:
        size = lambda b: len(zstandard.ZstdCompressor(level=rules.level).compress(b)) / len(b)
        low, high = next((a, b) for start, a, b in reversed(rules.bands) if len(raw) >= start)
        parts = [size(raw[i:i + rules.chunk_bytes]) for i in range(0, len(raw) - rules.chunk_bytes + 1, rules.chunk_bytes)]
        below, above = sum(p < rules.chunk_band[0] for p in parts), sum(p > rules.chunk_band[1] for p in parts)
        verdict = ("repetitive" if size(raw) < low else "incompressible" if size(raw) > high else
                   "repetitive chunks" if below > rules.chunk_share * len(parts) else
                   "incompressible chunks" if above > rules.chunk_share * len(parts) else "kept")
    return (*counts, failed, not failed and verdict == "kept", verdict)


def check(spark, docs, rows):
    rules = compression.Rules()
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                   r["base_failed"], r["kept"], r["verdict"]) for r in compression.judge(docs, rules).collect()), key=str)
    assert got == sorted(((d, *slow_row(t, rules)) for d, t in rows), key=str)
    return got


def test_odd_rows(spark, odd, odd_rows, empty):
    check(spark, odd, [r[:2] for r in odd_rows])
    assert compression.judge(empty).count() == 0
    kept = compression.judge(odd, carry=True).where("kept").select("row.*")
    assert kept.columns == odd.columns and kept.count() == compression.judge(odd).where("kept").count()


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = check(spark, docs, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(got) == 200


def test_bands_tell_repetition_and_noise_from_prose():
    import random

    import base64
    rng = random.Random(1)
    rules, c = compression.Rules(), zstandard.ZstdCompressor(level=3)
    noise = base64.b85encode(rng.randbytes(6000)).decode()
    assert compression.compression(noise, rules, c)[-1] == "incompressible"
    assert compression.compression("again and again " * 500, rules, c)[-1] == "repetitive"
    mixed = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(40_000)) + "same words here " * 5000
    found = compression.compression(mixed, rules, c)
    assert found[3] > 30 and found[-1].startswith("repetitive")


def test_good_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").select("doc_id")
    left = compression.judge(docs).join(good, "doc_id").where("not base_failed and not kept")
    assert left.count() == 0


def test_base64_inside_prose_is_found(spark):
    import base64
    import random
    rng = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = docs.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1"), "doc_id")
    prose = [r["text"] for r in good.where("length(text) > 2300").orderBy("doc_id").collect()]
    assert len(prose) > 50 and {r["lang"] for r in good.where("length(text) > 2300").collect()} >= {"de", "en", "es", "fr"}
    c, rules = zstandard.ZstdCompressor(level=3), compression.Rules()
    blob = base64.b64encode(rng.randbytes(60_000)).decode()
    for text in prose:
        assert compression.compression(text, rules, c)[-1] == "kept"
    long = " ".join(prose).encode("ascii", "ignore").decode()[:12_000]
    for share in (0.4, 0.45, 0.5):
        mixed = long[:int(9000 * (1 - share))] + blob[:int(9000 * share)]
        assert compression.compression(mixed, rules, c)[-1].startswith("incompressible"), share
    # the blob is a last chunk of less than 2 KiB, of each size with a limit
    for size in (900, 1200, 1700):
        found = compression.compression(long[:2048] + blob[:size], rules, c)
        assert found[2:5] == (2, 0, 1) and found[-1].startswith("incompressible"), size
    found = compression.compression(long[:4096] + blob[:300], rules, c)
    assert found[2:5] == (3, 0, 1) and found[-1] == "kept"
    assert compression.compression(long[:4096 + 100], rules, c)[2:5] == (2, 0, 0)
