"""The training-data operators on small fixtures, against brute force: nulls, empty and long texts, copies, ties, empty tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import langid, license_scan, mpegts, pii, quality, suffix_dedup, token_files
from tidemark.llm.decontaminate import find_contamination
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import deal, mix_sources, splitting_tree
from tidemark.llm.queries import vocabulary

# Columns with names that operators use inside, which must not get in their way.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, th string, h long, words string, size long, spans string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def make_docs():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeoé", k=rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(60))
    docs = [None, "", " \n\t ", "one", "Two words", "x" * 3000, " ".join(["same"] * 500), "a  b \n c", passage, passage]
    for _ in range(12):
        own = [word() for _ in range(80)]
        docs.append(" ".join(own))
        for _ in range(2):
            near = list(own)
            near[rng.randrange(80)] = word()
            docs.append(" ".join(near))
        docs.append(" ".join([*own[:30], passage, *own[30:]]).capitalize())
    docs.append(" ".join(word() for _ in range(20_000)))
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "a", "b", "é"][i % 4]) for i, t in enumerate(docs)]
    rows += [(None, "no id here at all", "en", "a"), (None, None, None, None), rows[10], rows[10]]
    return [(*r, 7, 1, "t", 2, "w", 3, "s") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(docs, rows, empty):
    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a][1] & sets[b][1])
        if both and 100 * both >= 75 * len(sets[a][1] | sets[b][1]):
            parent[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    want = sorted(((d, len(s), least.get(root(i)) if s else d) for i, (d, s) in enumerate(sets)), key=str)
    got = near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_link_rows_without_id(spark):
    words = [f"w{i}" for i in range(200)]
    changed = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    near, lone = " ".join(f"v{i}" for i in range(100)), " ".join(f"u{i}" for i in range(100))
    # Of 196 shingles, 20 differ between the null-id bridge and either end, and 40 between the ends: 0.82 and 0.66.
    rows = [(1, changed(10, 50, 90, 130)), (None, changed()), (2, changed(30, 70, 110, 150)), (None, near), (3, near + " end"), (None, lone), (4, None), (4, ""), (None, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == sorted(
        [(1, 196, 1, True), (None, 196, 1, False), (2, 196, 1, False), (None, 96, 3, False), (3, 97, 3, True), (None, 96, None, True), (4, 0, 4, True), (4, 0, 4, True), (None, 0, None, True)], key=str
    )


def test_decontamination(spark, docs, rows, empty):
    items = [(1, rows[8][1]), (2, "two WORDS"), (3, None), (4, ""), (10, rows[8][1]), (11, " ".join(["same"] * 12)), (12, "never seen in any document of this table at all, no")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    want = []
    for doc, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(10, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(item)
        want.append((doc, len(w), len(hit), sorted(map(str, found))))
    got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in find_contamination(docs, benchmark).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    joined = [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in find_contamination(docs, benchmark, broadcast_windows=0).collect()]
    assert sorted(joined, key=str) == sorted(want, key=str)
    assert find_contamination(empty, benchmark).count() == 0
    assert find_contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("most", [100_000, 1])
def test_suffix_dedup(docs, rows, empty, most):
    texts, length = [(r[0], (r[1] or "").encode()) for r in rows], 40
    seen = {}
    for _, t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    want = []
    for doc, t in texts:
        gone = np.zeros(len(t) + 1, np.int8)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = 1
        kept = bytes(b for b, g in zip(t, gone[:-1], strict=True) if not g)
        want.append((doc, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.remove_repeats(docs, length, 16, batch_rows=16, most_snippets=most).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffix_dedup.remove_repeats(empty, length, 16).count() == 0


def test_suffix_dedup_splits_busy_heads(spark, monkeypatch):
    """One line in 400 different surroundings: no plan lists its windows one by one, parts stay few, and results are brute force's."""
    rng = random.Random(3)
    some = lambda n: "".join(rng.choices("abcdefghij", k=n))
    line, length, plans, parts = some(90), 40, [], []
    sides = [some(30) for _ in range(8)]
    texts = [rng.choice([*sides, some(30)]) + line[rng.choice([0, 0, 5, 20]) : rng.choice([50, 70, 90, 90])] + rng.choice([*sides, some(30)]) + some(20) for _ in range(400)]
    real = suffix_dedup.materialise

    def watched(df, name, *rest):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = real(df, name, *rest)
        if name == "parts":
            parts.append(out.count())
        return out

    monkeypatch.setattr(suffix_dedup, "materialise", watched)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame, length, 16, most_snippets=20).collect()}
    assert parts and sum(parts) < 12 * len(texts) and not any("explode" in x for x in plans)
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    for doc, t in enumerate(texts):
        gone = np.zeros(len(t) + 1, np.int8)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = 1
        kept = "".join(c for c, g in zip(t, gone[:-1], strict=True) if not g)
        assert got[doc] == (int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept.encode()).hexdigest()), doc


def test_suffix_index_takes_batches(spark, docs, rows, empty):
    one, more = (sorted(map(tuple, suffix_dedup.remove_repeats(docs, 40, 16, batches=n).collect()), key=str) for n in (1, 5))
    assert one == more
    # A batch that comes later meets an earlier one, and both are told.
    text = "".join(random.Random(1).choices("abcdefgh", k=400))
    frames = [spark.createDataFrame([(i, i, t)], "k long, th long, text string") for i, t in enumerate((text, "x" + text[50:350], "nothing of it"))]
    index = suffix_dedup.SuffixIndex(frames[0].union(frames[1]).union(frames[2]), 40, 16)
    found = [index.append(f).collect() for f in frames]
    assert [len(f) > 0 for f in found] == [False, True, False]
    covered = {k: {x for r in found[1] if r.k == k for x in range(r.a, r.b)} for k in (0, 1)}
    assert covered == {0: set(range(50, 350)), 1: set(range(1, 301))}
    assert [x is not None for x in index.levels] == [True, True]
    index.close()


def test_suffix_dedup_of_periodic_text(spark):
    frame = spark.createDataFrame([(1, "x" * 300_000), (2, "abc" * 90_000), (3, "y" * 200), (4, "z" * 201 + "end"), (5, "head" + "y" * 200)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(frame).collect()}
    assert got == {1: (300_000, 1), 2: (270_000, 1), 3: (200, 1), 4: (201, 1), 5: (200, 1)}


def test_personal_data(spark, empty):
    texts = [
        None, "", "Mail a.b@x.org, or a@b@c.de; 1.2.3.4 and 1.2.3.256 and 1.2.3.4.5", "card 4111 1111 1111 1111 or 4111-1111-1111-1112, tel +1 (555) 555-1234 é +1 23",
        "ü" * 50 + " +49 30 1234567 x@y.z_w@k.lm " + "7" * 5000, "a" * 100_000, "+1 2" * 1000, "x@y.zz " * 300,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)) + [(2, texts[2])], "doc_id long, text string")
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            twice = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    got = {}
    for r in pii.find_personal_data(frame).select("doc_id", pii.span_text(F.col("base")).alias("b"), pii.span_text(F.col("spans")).alias("s")).collect():
        got[r.doc_id] = r.b
        assert set(r.b.split(",")) <= set(r.s.split(","))
    for i, text in enumerate(texts):
        if i == 5:
            assert got[i] == ""  # the naive pattern takes a square of its length
            continue
        found = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(patterns.items()) for m in re.finditer(p, text or "") if valid(kind, m[0]))
        assert got[i] == ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found), i
    zeros = spark.createDataFrame([(1, "10.0.0.1 and 0.0.0.0, 1.2.3.00 or 192.168.000.255"), (2, "10.0.0.256 and 1.2.3.0400")], "doc_id long, text string")
    assert {r.doc_id: (r.n_ip, r.b) for r in pii.find_personal_data(zeros).select("doc_id", "n_ip", pii.span_text(F.col("base")).alias("b")).collect()} == {1: (4, "ip:0:8,ip:13:20,ip:22:30,ip:34:49"), 2: (0, "")}
    assert pii.find_personal_data(empty.select("doc_id", "text")).count() == 0
    line = spark.createDataFrame([("call +1 555 555 1234 now",)], "text string")
    spans = F.array(F.struct(F.lit(5).alias("start"), F.lit(3).alias("kind"), F.lit(20).alias("end")))
    assert line.select(pii.redact(F.col("text"), spans, "#").alias("t")).first().t == "call " + "#" * 15 + " now"


def test_personal_data_adds_unmarked_forms(spark):
    rng = random.Random(7)
    digits = lambda n: "".join(rng.choices("23456789", k=n))
    texts = []
    for i in range(400):
        phone, mail = f"({digits(3)}) {digits(3)}-{digits(4)}", f"n{i} (at) host{i} (dot) org"
        texts.append(f"call +1 {phone} or n{i}@host{i}.org about 2020-01-{10 + i % 20}. Items 10 20 30 40 50. See this @ noon.")
        if i % 20 == 0:
            texts.append(f"reach me under {phone} or {mail}. Thanks, 1.2.3.999")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_personal_data(frame).select("doc_id", pii.span_text(F.col("base")).alias("b"), pii.span_text(F.col("spans")).alias("s")).collect():
        text = texts[r.doc_id]
        if text.startswith("reach"):
            phone, mail = text.index("("), text.index(" or ") + 4
            assert r.b == "" and r.s == f"phone:{phone}:{phone + 14},email:{mail}:{text.index('. Thanks')}"
        else:
            assert r.s == r.b and r.b.count(":") == 4


def test_personal_data_of_long_texts(spark):
    """Many matches in one text: places as told by Python's own patterns, overlaps by comparing all pairs."""
    text = "mail a.b@c.de, 10.0.0.1 or +49 30 1234567; 4111 1111 1111 1111, 555-123-4567 x (at) y (dot) org é " * 3000
    row = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert [tuple(b) for b in row.base if b.kind == 0] == want
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (3000, 3000, 3000, 3000)
    spans = [tuple(b) for b in row.spans]
    assert all(a[2] <= b[0] for a, b in itertools.pairwise(spans))


def test_boosting_learns():
    cells = [({**dict.fromkeys(pii.FEATURES, 0), "digits": d, "lead": x}, 10.0 * (d > 4), 10.0 * (d <= 4)) for d in range(9) for x in range(4)]
    model = pii.boost(cells)
    assert all((pii.tree_value(model, f) > 0) == (p > 0) for f, p, _ in cells)


def test_token_files(docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    got = token_files.token_index(docs, vocabulary(), folder=f"file://{tmp_path}/out").orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    want = sorted((str(d), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ((r[0], ids(r[1])) for r in rows))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    assert all(b.start == a.start + a.n_tokens for a, b in itertools.pairwise(got)) and got[0].start == 0
    assert token_files.token_index(empty, vocabulary()).count() == 0


def test_encoder_equals_whole_texts(spark):
    encoder = token_files.Encoder(vocabulary(), 0, most_bytes=200_000)
    texts = ["a  b", " a b", "a\n b", "a b\n", "a <|endoftext|> b", "it's 'll we'll x", "tab\tb c", "é ü, x.", "don't 's a,", "A1 b2, c3. d!\nE f.", " x y", "", None, "\n", " ", "Ёлка, да.\nнет!", "\u2003x y\u00a0z", "日本 語。a", "\n\nx", "x ,'s ''d", "ﬁ ǅa,"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    flat, sizes = encoder.encode(pa.array(texts, pa.string()))
    got = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
    assert got == [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_wide_ids_and_other_tokenisers(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    wide = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 70_000, "b": 1}, unk_token="[UNK]"))
    wide.pre_tokenizer = pre_tokenizers.Whitespace()
    wide.save(f"{tmp_path}/wide.json")
    rows = spark.createDataFrame([(2, "a b"), (1, "b zzz"), (None, None)], "doc_id long, text string")
    got = token_files.token_index(rows, f"{tmp_path}/wide.json", end_id=90_000, folder=f"{tmp_path}/out").orderBy("start").collect()
    want = [[90_000], [1, 0, 90_000], [70_000, 1, 90_000]]
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 1), (1, 1, 3), (2, 4, 3)]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]


def test_media(docs, rows, empty):
    got = mpegts.media_features(docs).collect()
    by_text = {}
    for r in got:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())
    want = sorted((len((t or "").encode()), hashlib.sha256(mpegts.padded((t or "").encode())).hexdigest()) for _, t, *_ in rows)
    assert sorted((r.n_bytes, r.payload_sha256) for r in got) == want
    assert mpegts.media_features(empty).count() == 0
    stream = bytearray(mpegts.store(b"z" * 40_000))
    assert mpegts.parse(bytes(stream)).random_access[0] == 2 * mpegts.PACKET
    del stream[mpegts.PACKET * 9 : mpegts.PACKET * 10]
    assert mpegts.parse(bytes(stream)).discontinuities == 1
    with pytest.raises(ValueError, match="synchronisation"):
        mpegts.parse(b"x" * mpegts.PACKET)


def test_language_models(spark, docs, empty):
    models = {}
    for lang, text in (("en", "the cat sat on the mat and the dog ran " * 40), ("de", "der hund und die katze sind auf dem haus " * 40)):
        data = np.frombuffer(text.encode(), np.uint8)
        models[lang] = langid.KneserNey(*np.unique(langid.grams(data, np.array([0, len(data)]))[0], return_counts=True))
        context = models[lang].keys[4][0] >> np.uint64(16)
        every = (context << np.uint64(16)) | models[lang].keys[1]
        assert models[lang].prob(4, every).sum() + models[lang].prob(4, np.array([(context << np.uint64(16)) | np.uint64(0x7777)], np.uint64))[0] == pytest.approx(1, abs=0.02)
    both = langid.LanguageModels(models)
    frame = spark.createDataFrame([(1, "the dog sat"), (2, "die katze und der hund"), (3, None), (4, "123 !!"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict_languages(frame, both).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert got[3].score == 0 and not got[3].accepted and 0.5 <= got[1].score <= 1
    assert langid.identify_languages(empty).count() == 0
    out = langid.identify_languages(docs).collect()
    assert len(out) == docs.count() and all(r.lang_pred in ("en", "fr", "und") for r in out)


def test_mapped_language_models_equal_broadcast_ones(spark):
    rng = random.Random(3)
    texts = lambda letters, n: ["".join(rng.choices(letters + " ", k=300)) for _ in range(n)]
    rows = [(i, t, lang) for lang, letters, n in (("hot", "abcdefgh", 40), ("rare", "xyzé", 2), ("han", "\u4e00\u9fa5\u8a9e\U00020000", 5)) for i, t in enumerate(texts(letters, n))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole, mapped = langid.train_languages(frame, frame), langid.train_languages(frame, frame, most_grams=10)
    assert mapped.langs == whole.langs == ["han", "hot", "rare"] and mapped.temperature == whole.temperature
    assert mapped.most_entropy == pytest.approx(whole.most_entropy, rel=1e-6)
    for a, b in zip(whole.models, mapped.models, strict=True):
        for order in (1, 2, 3, 4):
            assert b.prob(order, a.keys[order]) == pytest.approx(a.p[order], rel=1e-12)
        assert b.prob(4, a.keys[4] ^ np.uint64(1 << 32)) == pytest.approx(a.prob(4, a.keys[4] ^ np.uint64(1 << 32)), rel=1e-12)
    got = [sorted((r.doc_id, r.lang, r.lang_pred, round(r.entropy, 5)) for r in langid.predict_languages(frame, m).collect()) for m in (whole, mapped)]
    assert got[0] == got[1] and all(lang == pred for _, lang, pred, _ in got[1])


def test_languages_are_calibrated_on_every_row(spark):
    """Temperature and highest accepted entropies of 12,000 rows against numpy over all of them; the oddest rows come once each."""
    rng = random.Random(11)
    letters = {"a": "abcdefgh", "b": "efghijkl", "c": "ijklmnop"}
    text = lambda lang, n: "".join(rng.choices(letters[lang] + " ", k=n))
    train = spark.createDataFrame([(i, text(x, 400), x) for i in range(30) for x in letters], "doc_id long, text string, lang string")
    rows = [(i, text(x, 24), x) for i, x in enumerate(rng.choices("abc", k=12_000))]
    rows += [(20_006 + i, t, x) for i, (t, x) in enumerate([("xyzz", "a"), ("qrst", "b"), ("uvwx", "c"), (None, "a"), ("", "b"), ("12 !", "c"), ("abc", None), ("abc", "d")])]
    got = langid.train_languages(train, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    known = [(t, x) for _, t, x in rows if t and x in letters and re.search("[a-z]", t)]
    flat = np.frombuffer("".join(t for t, _ in known).encode(), np.uint8)
    packed, ends, _ = langid.grams(flat, np.cumsum([0] + [len(t) for t, _ in known]))
    h, truth = got.entropies(packed, ends), np.array([got.langs.index(x) for _, x in known])
    loss = [-np.log(np.maximum(got.scores(h, t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in langid._TEMPERATURES]
    assert got.temperature == langid._TEMPERATURES[int(np.argmin(loss))]
    for k, model in enumerate(got.models):
        top = h[truth == k, k].max()
        assert got.most_entropy[k] == pytest.approx(top + 0.25 * max(0.0, -np.log(model.uniform) - top))
    held = langid.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), got)
    assert held.where("lang in ('a', 'b', 'c') and lang_pred = lang and not accepted").count() == 0


def test_cross_trained_languages_count_and_calibrate_every_row(spark):
    """Counts, temperature and highest accepted entropies of all rows, null and repeated ids among them, against numpy over all of them."""
    rng = random.Random(5)
    letters = {"a": "abcdefgh", "b": "efghijkl", "c": "ijklmnop"}
    rows = [(i % 900 or None, "".join(rng.choices(letters[x] + " ", k=40)), x) for i, x in enumerate(rng.choices("abc", k=3000))]
    rows += [(1, "xyzz", "a"), (2, "qrst", "b"), (3, "qrst", "b"), (4, None, "a"), (5, "", "b"), (6, "12 !", "c"), (7, "abc", None), (8, "uvw uvw", "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got, mapped = langid.cross_train_languages(frame), langid.cross_train_languages(frame, most_grams=10)
    known = [(t, x, zlib.crc32(t.encode()) % 2) for _, t, x in rows if t and x]

    def packed(texts):
        return langid.grams(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t) for t in texts]))[:2]

    def learned(some):
        langs = sorted({x for _, x, _ in some})
        return langid.LanguageModels({x: langid.KneserNey(*np.unique(packed([t for t, y, _ in some if y == x])[0], return_counts=True)) for x in langs})

    whole = learned(known)
    assert got.langs == mapped.langs == whole.langs == ["a", "b", "c", "d"]
    for a, b in zip(whole.models, got.models, strict=True):
        assert all((a.keys[k] == b.keys[k]).all() and (a.p[k] == b.p[k]).all() for k in (1, 2, 3, 4))
    loss, top = np.zeros(len(langid._TEMPERATURES)), {}
    for f in (0, 1):
        half = learned([r for r in known if r[2] != f])
        own = [r for r in known if r[2] == f and r[1] in half.langs and re.search("[a-z]", r[0])]
        h, truth = half.entropies(*packed([t for t, _, _ in own])), np.array([half.langs.index(x) for _, x, _ in own])
        loss += [-np.log(np.maximum(half.scores(h, t)[np.arange(len(own)), truth], 1e-12)).sum() for t in langid._TEMPERATURES]
        for lang, x in zip((x for _, x, _ in own), h[np.arange(len(own)), truth], strict=True):
            top[lang] = max(x, top.get(lang, x))
    assert sorted(top) == ["a", "b", "c"]  # the only row of d is in one half
    want = [top[x] + 0.25 * max(0.0, -np.log(m.uniform) - top[x]) if x in top else np.inf for x, m in zip(whole.langs, whole.models, strict=True)]
    for models in (got, mapped):
        assert models.temperature == langid._TEMPERATURES[int(np.argmin(loss))]
        assert models.most_entropy == pytest.approx(want, rel=1e-6)
    none = langid.cross_train_languages(frame.where("lang is null"))
    assert none.langs == [] and {r.lang_pred for r in langid.predict_languages(frame, none).collect()} == {"und"}


def test_quality(spark, docs, rows, empty):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(60)) if i % 2 else "BUY NOW!! " * 40 for i in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(None, 1, 0), (3, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(frame, labels).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == r.doc_id % 2 for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(docs, labels).count() == len(rows)
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(empty, labels).count() == 0
    x, y = quality.pool_adjacent(np.array([0.0, 1, 2, 3]), np.array([0, 2, 1, 3]), np.array([3, 3, 3, 3]))
    assert list(x) == [0, 1, 2, 3] and list(y) == [0, 0.5, 0.5, 1]


def test_mixing(docs, rows, empty):
    got = mix_sources(docs, shards=5).collect()
    sizes, weights = {}, {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weights[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 3 * r.size
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs.repartition(7), shards=5).collect()))
    dealt = deal(mix_sources(docs, shards=5)).collect()
    assert len(dealt) == sum(len(r.shards) for r in got)
    assert mix_sources(empty).count() == 0


def test_splitting_tree_keeps_counts():
    tree = splitting_tree([1000, 10, 0, 333], 7, 3)
    assert tree.sum(0).tolist() == [1000, 10, 0, 333] and max(tree.sum(1)) - min(tree.sum(1)) <= 6


def test_licenses(spark, docs, empty):
    mit = dict(license_scan.TEMPLATES)["MIT"]
    rows = [
        (1, "a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
        (2, "a/b/c/code.txt", "nothing here"), (3, "a/b/other.txt", "Licensed under CC BY-NC 4.0.\nplain words follow " + "w " * 300), (4, "z/code.txt", "none"), (5, None, None),
        (6, "a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (7, "a/x.txt", ""), (8, "top.txt", mit * 3),
    ]
    frame = spark.createDataFrame([(i, t, p) for i, p, t in rows], "doc_id long, text string, path string")
    got = {r.doc_id: (r.license, r.how) for r in license_scan.scan_licenses(frame, F.col("path")).collect()}
    assert got[1] == ("MIT", "file") and got[2] == ("GPL-3.0", "inherited") and got[3] == ("CC-BY-NC-4.0", "header")
    assert got[7] == ("MIT", "inherited") and got[5] == (None, None) and got[6] == ("GPL-3.0", "file")
    assert got[4] in ((None, None), ("MIT", "inherited"))
    assert license_scan.scan_licenses(empty, F.lit("x/y")).count() == 0
    assert license_scan.scan_licenses(docs, F.lit("x/y")).count() == docs.count()


def test_licenses_of_complete_texts(spark):
    whole = dict(license_scan.whole_texts())
    mit = "The MIT License (MIT)\n\nCopyright (c) 2015 Some One\n\n" + whole["MIT"].partition("\n\n")[2]
    kinds = {"mit": ("MIT", mit), **{x: (x, whole[x]) for x in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")}}
    rows = [(f"{d}/{name}", text) for d, (_, text) in kinds.items() for name, text in (("LICENSE", text), ("src/deep/code.txt", "plain words"))]
    lines = {"MIT": "// SPDX-License-Identifier: MIT", "GPL-3.0": "# SPDX-License-Identifier: GPL-3.0-or-later", "Apache-2.0": "License: Apache-2.0"}
    rows += [(f"z/{x}", line + "\n" + "plain words follow " * 50) for x, line in lines.items()] + [("z/ISC", "SPDX-License-Identifier: ISC"), ("z/prose", "The permission of the author and the terms of the work are such that you may not. " * 40)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.path: (r.license, r.how) for r in license_scan.scan_licenses(frame, F.col("path")).collect()}
    for d, (x, _) in kinds.items():
        assert got[f"{d}/LICENSE"] == (x, "file") and got[f"{d}/src/deep/code.txt"] == (x, "inherited"), d
    assert {x: got[f"z/{x}"] for x in lines} == {x: (x, "header") for x in lines}
    assert got["z/ISC"] == got["z/prose"] == (None, None)


def test_pipeline_stages_decide_on_null_texts(spark, empty):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "some few words in here", "en", "a", 22), (3, "some few words in here", "en", "a", 22), (4, "some few words in here", "en", "a", 22), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.deduplicate(spark, frame, "").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, None), (2, ""), (3, rows[2][1]), (None, None)], key=str)
    assert corpus_pipeline.deduplicate(spark, empty.select(corpus_pipeline.COLUMNS), "").count() == 0
    null_key = spark.range(1).select(F.xxhash64(F.lit(""))).first()[0]
    assert {r.th for r in mix_sources(frame).where("doc_id = 1 or doc_id is null").collect()} == {null_key}
