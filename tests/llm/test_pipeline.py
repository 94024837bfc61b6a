"""The pipeline's stages, each and together, against plain Python."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.queries import vocabulary

LETTERS = {"en": "abcdefghij", "de": "klmnopqrst"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(LETTERS[lang], k=rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Two languages of invented words, texts without letters, copies, near copies and passages of the benchmark."""
    rng = random.Random(7)
    items = [sentence(rng, "en", 14) for _ in range(3)]
    rows = []
    for i in range(160):
        lang = ("en", "de")[i % 2]
        rows.append((i, sentence(rng, lang, rng.randint(20, 60)), lang, f"s{i % 3}", 1))
    rows += [(200 + i, None if i % 2 else "12 34 !!", "en", "s0", None) for i in range(4)]
    rows += [(210, "", None, None, 0), (None, sentence(rng, "en", 30), "en", None, 3)]
    rows += [(300 + i, rows[2 * i][1], "en", "s1", 2) for i in range(5)]
    rows += [(320 + i, rows[2 * i + 1][1] + " klmno", "de", "s2", 2) for i in range(5)]
    rows += [(340 + i, sentence(rng, "en", 9) + " " + items[i % 3].upper() + " " + sentence(rng, "en", 9), "en", "s0", 5) for i in range(6)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def alike(a, b):
    return bool(a) and 100 * len(a & b) >= 75 * len(a | b)


def stages(spark, folder, tmp_path):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        out.append(docs)
    return out


def test_stages_against_plain_python(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    folder, rows, items = corpus
    identified, single, clean, mixed, tokens = stages(spark, folder, tmp_path)
    assert all(d.columns == corpus_pipeline.COLUMNS for d in (identified, single, clean, mixed))

    # Language: texts with letters of a learned language stay, whatever their label; the others go.
    got = {r.doc_id: r.lang for r in identified.collect()}
    want = {d: ("en" if set(t.lower()) & set(LETTERS["en"]) else "de") for d, t, *_ in rows if t and re.search("[a-z]", t.lower())}
    assert got == want

    # Near duplicates: the least id of each component stays.
    texts = {r.doc_id: r.text for r in identified.collect()}
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if root[a] != root[b] and alike(sets[a], sets[b]):
                low = min((root[a], root[b]), key=lambda x: (x is None, x))
                root = {d: low if r in (root[a], root[b]) else r for d, r in root.items()}
                break
        else:
            break
    assert {r.doc_id for r in single.collect()} == set(root.values())
    assert 300 not in root.values() and 320 not in root.values()

    # Benchmark: documents that hold ten words in a row of an item go.
    def windows(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        return {tuple(w[i : i + 10]) for i in range(len(w) - 9)}

    bad = set().union(*(windows(t) for t in items))
    left = {r.doc_id: r.text for r in single.collect()}
    assert {r.doc_id for r in clean.collect()} == {d for d, t in left.items() if not windows(t) & bad}
    assert not {340, 345} & {r.doc_id for r in clean.collect()}

    # Mixing: words of each source near its target, no document more than three times.
    size = {r.doc_id: len(r.text.split()) for r in clean.collect()}
    source = {r.doc_id: r.source for r in clean.collect()}
    own = {s: sum(size[d] for d in size if source[d] == s) for s in set(source.values())}
    order = sorted((s for s in own if s is not None)) + [s for s in own if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, set(own), float(sum(own.values()))
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * own[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * own[s]
            rest -= target[s]
        free -= over
    taken = [r.doc_id for r in mixed.collect()]
    assert max(taken.count(d) for d in set(taken)) <= 3
    for s in own:
        assert abs(sum(size[d] for d in taken if source[d] == s) - target[s]) <= max(size[d] for d in size if source[d] == s), s

    # Token files: the mix in its own order, as the library encodes it, one after another.
    written = mixed.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).orderBy("file", "row").collect()
    got = tokens.orderBy("start").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in written] != sorted(taken, key=str)
    tokenizer = Tokenizer.from_file(vocabulary())
    at = 0
    for r, w in zip(got, written, strict=True):
        ids = [*tokenizer.encode(w.text, add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)

    # The run as a whole is its stages.
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in whole) == sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got)


def test_languages_are_accepted_by_every_calibrating_row(spark):
    """Of some 6,000 calibrating documents, the two oddest are accepted as well: both languages' limits come from all rows."""
    rng = random.Random(9)
    rows = [(i, sentence(rng, lang, 4), lang, "s", 1) for i, lang in enumerate(rng.choices(["en", "de"], k=12_000))]
    odd = [(20008, "xyzz", "en", "s", 1), (20017, "xyzz", "de", "s", 1)]
    assert all(zlib.crc32(str(r[0]).encode()) % 2 == 1 for r in odd)  # the fold that calibrates
    got = corpus_pipeline.identify(spark, spark.createDataFrame(rows + odd, SCHEMA).repartition(4), "")
    assert {r.doc_id for r in got.where("text = 'xyzz'").collect()} == {r[0] for r in odd}


def test_languages_are_learned_from_every_row(spark):
    """A language all of whose documents have ids of one remainder is learned as well, from whichever."""
    rng = random.Random(13)
    for side in (0, 1):
        ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 2 == side]
        rows = [(1000 + i, sentence(rng, lang, 20), lang, "s", 1) for i, lang in enumerate(["en", "de"] * 60)]
        rows += [(i, " ".join("".join(rng.choices("uvwxyz", k=5)) for _ in range(20)), "fr", "s", 1) for i in ids[:40]]
        got = corpus_pipeline.identify(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
        assert {r.doc_id: r.lang for r in got} == {r[0]: r[2] for r in rows}


def test_run_of_an_empty_table(spark, corpus, tmp_path):
    folder, _, _ = corpus
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
