"""Operators on texts against plain versions, with the hard cases."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tests.llm.cases import STOCK, docs_frame, documents, sentence, with_clashes
from tickloom.llm import bpe, decontaminate, language_id, line_dedup, simhash, suffix_dedup, toxicity


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return docs_frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_frame(spark, []).cache()


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# --- 4: byte pairs ----------------------------------------------------------------------


def test_bpe_equals_the_library(docs):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    want = []
    for doc_id, text, *_ in documents():
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(back.encode())))
    assert rows_of(bpe.digests(docs, bpe.vocabulary_path())) == sorted(want, key=repr)


def test_bpe_forgets_words_and_keeps_columns(docs, empty, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 5)
    with open(bpe.vocabulary_path(), encoding="utf-8") as f:
        small = bpe.Vocabulary(f.read())
    texts = [t or "" for _, t, *_ in documents()]
    first = [x.tolist() for x in small.encode(texts)]
    assert [x.tolist() for t in texts for x in small.encode([t])] == first
    coded = bpe.encode(with_clashes(docs), bpe.vocabulary_path())
    assert coded.select("score", "fp").distinct().collect() == [("own", "own")]
    assert coded.filter("text IS NULL").select(F.size("ids")).first()[0] == 0
    assert bpe.encode(empty, bpe.vocabulary_path()).count() == 0


# --- 5: decontamination -----------------------------------------------------------------

_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(rows, items, window=10):
    table = {}
    for item, text in items:
        w = plain_words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            if item is not None:
                table.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    out = []
    for doc_id, text in rows:
        w, hit, found = plain_words(text), set(), set()
        for m in {len(k) for k in table}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in table:
                    found |= table[tuple(w[i : i + m])]
                    hit.update(range(i, i + m))
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_decontamination_equals_search(spark, docs, empty, monkeypatch):
    rows = [(r[0], r[1]) for r in documents()]
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    items = [
        (1, " ".join(texts[0].split()[5:27]).upper() + "!"),
        (2, " ".join(texts[1].split()[:12])),
        (2, "a repeated id " + " ".join(texts[2].split()[:11])),
        (3, "again and same words again and same"),
        (4, None),
        (5, " ... "),
        (None, "x"),
        (6, "x"),
        (10, " ".join(texts[4].split()[3:13])),
    ]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    names = ["doc_id", "n_words", "n_hit", "items"]
    want = plain_hits(rows, items)
    assert rows_of(decontaminate.contaminated(with_clashes(docs), benchmark).select(names)) == want
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", 5)  # many slices
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 2000)  # small shards
    assert rows_of(decontaminate.contaminated(docs, benchmark).select(names)) == want
    left = {r["doc_id"]: r["text"] for r in decontaminate.cleaned(docs, benchmark).collect()}
    hits = {d: n for d, _, n, _ in want}
    for doc_id, text in rows:
        if doc_id is not None:
            assert (left[doc_id] == text) == (hits[doc_id] == 0)
    assert decontaminate.contaminated(empty, benchmark).count() == 0
    none = benchmark.limit(0)
    assert decontaminate.contaminated(docs, none).agg(F.sum("n_hit")).first()[0] == 0


def test_fm_index_counts_and_places():
    from tickloom.llm.fm_index import FmIndex

    draw = np.random.default_rng(1)
    for _ in range(30):
        s = draw.integers(1, 5, draw.integers(1, 80))
        index = FmIndex(s, 6)
        for m in range(1, 5):
            p = draw.integers(1, 5, (6, m))
            lo, hi = index.search(p, np.full(6, m))
            for k in range(6):
                want = [i for i in range(len(s) - m + 1) if (s[i : i + m] == p[k]).all()]
                assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


# --- 9: fingerprints --------------------------------------------------------------------


def plain_fingerprint(text):
    w = [x for x in regex.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values):
    """By fingerprint the index of its component; links at two bits or fewer."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_fingerprints_and_components(spark, docs, empty):
    rows = [(r[0], plain_fingerprint(r[1])) for r in documents()]
    comp = plain_components([f for _, f in rows])
    least = {}
    for doc_id, f in rows:
        if doc_id is not None:
            least[comp[f]] = min(doc_id, least.get(comp[f], doc_id))
    want = sorted(((d, f - (1 << 64) if f >> 63 else f, least.get(comp[f])) for d, f in rows), key=repr)
    marked = simhash.fingerprints(with_clashes(docs))
    found = simhash.with_components(marked).select("doc_id", "fp", "component_id")
    assert rows_of(found) == want
    assert simhash.with_components(simhash.fingerprints(empty)).count() == 0


def test_covering_tables_miss_no_pair(spark):
    draw = random.Random(9)
    values = set()
    for _ in range(60):
        x = draw.getrandbits(64)
        for _ in range(draw.randint(1, 6)):  # chains of small steps
            values.add(x)
            for _ in range(draw.randint(0, 3)):
                x ^= 1 << draw.randrange(64)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    from tickloom.llm.graph import components

    found = components(simhash.links(spark.createDataFrame(signed, "fp bigint"))).collect()
    own = {r["node"] % (1 << 64): r["root"] for r in found}
    comp = plain_components(values)
    groups = {}
    for v in values:
        groups.setdefault(comp[v], set()).add(v)
    for members in groups.values():
        if len(members) > 1:
            assert len({own[v] for v in members}) == 1
        else:
            assert not members & own.keys()
    masks = [m % (1 << 64) for m in simhash.covering_masks()]
    for i in range(64):
        for j in range(i + 1):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_components_of_a_long_path(spark):
    from tickloom.llm.graph import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (None, 3), (90, 91)], "a bigint, b bigint")
    want = [(i, 0) for i in range(41)] + [(90, 90), (91, 90)]
    assert sorted(tuple(r) for r in components(edges).collect()) == want


# --- 2: lines ---------------------------------------------------------------------------


def plain_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_banded_distance():
    draw = random.Random(3)
    a, b = [], []
    for _ in range(2000):
        x = bytes(draw.choice(b"abc") for _ in range(draw.randint(0, 14)))
        y = bytearray(x)
        for _ in range(draw.randint(0, 4)):
            i = draw.randint(0, len(y))
            y[i : i + draw.randint(0, 1)] = draw.choice([b"", b"c", b"b"])
        a.append(x)
        b.append(bytes(y))
    want = [plain_distance(x, y) <= line_dedup.EDITS for x, y in zip(a, b)]
    assert line_dedup.within(a, b).tolist() == want


def line_rows():
    """Families of lines a few edits apart, so that keys are crowded."""
    draw = random.Random(8)
    out, family = [], [sentence(draw, 8, STOCK["en"]).encode() for _ in range(4)]
    for i in range(60):
        own = []
        for _ in range(draw.randint(1, 5)):
            x = bytearray(draw.choice(family))
            for _ in range(draw.choice([0, 0, 1, 2, 3, 4])):
                k = draw.randint(0, len(x))
                x[k : k + draw.randint(0, 1)] = draw.choice([b"", b"q", b"z"])
            own.append(bytes(x).decode())
        out.append((i, "\n".join(own), "en", "s", 1))
    return out


def plain_lines(rows):
    first = {}
    big = (1 << 63) - 1
    place = lambda d: big if d is None else d
    for d, text in sorted(rows, key=lambda r: place(r[0])):
        for k, x in enumerate((text or "").encode().split(b"\n")):
            if len(x) >= line_dedup.LEAST:
                first[x] = min(first.get(x, (big, 1 << 30)), (place(d), k))
    names = sorted(first, key=lambda x: (first[x], x))
    near = set()
    for i, x in enumerate(names):
        for y in names[:i]:
            if abs(len(x) - len(y)) <= line_dedup.EDITS and plain_distance(x, y) <= line_dedup.EDITS:
                near.add(x)
                break
    out = []
    for d, text in rows:
        parts = (text or "").encode().split(b"\n") if text else []
        drop = [len(x) >= line_dedup.LEAST and (x in near or first[x] != (place(d), k)) for k, x in enumerate(parts)]
        kept = b"\n".join(x for x, gone in zip(parts, drop) if not gone).decode()
        out.append((d, None if text is None else kept, len(parts), sum(drop), sum(x in near for x in parts)))
    return sorted(out, key=repr)


RESULT = ["doc_id", "kept", "n_lines", "n_dropped", "n_near"]


@pytest.mark.parametrize("pairs", [1500, 3, 0])
def test_lines_equal_all_pairs(spark, monkeypatch, pairs):
    monkeypatch.setattr(line_dedup, "PAIRS", pairs)  # 3: every family goes on to finer keys
    rows = line_rows()
    found = line_dedup.deduplicated(docs_frame(spark, rows)).select(RESULT)
    assert rows_of(found) == plain_lines([r[:2] for r in rows])


def test_lines_of_hard_cases(docs, empty):
    rows = documents()[110:]
    found = line_dedup.deduplicated(with_clashes(docs_frame(docs.sparkSession, rows))).select(RESULT)
    assert rows_of(found) == plain_lines([r[:2] for r in rows])
    kept = line_dedup.deduplicated(with_clashes(docs_frame(docs.sparkSession, rows)))
    assert [tuple(r) for r in kept.select("drop_id", "drop_text", "drops").distinct().collect()] == [("own",) * 3]
    assert line_dedup.deduplicated(empty).count() == 0


def test_short_lines_take_part(spark):
    texts = ["Les.\nseventeen letters\n\nabc", "Les.\nsevenTeen letters\n\nabd", "les.\nsevenTEen letters\nx", "x\nLes.\nnineteen bytes long", "nineteen bytes lonGEr"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    found = {r["doc_id"]: (r["kept"], r["n_dropped"], r["n_near"]) for r in line_dedup.deduplicated(docs_frame(spark, rows)).collect()}
    assert found == {
        0: ("Les.\nseventeen letters\n\nabc", 0, 0),
        1: ("\nabd", 2, 1),  # one edit of a line of 17 bytes; none of one of 3
        2: ("les.\nx", 1, 1),  # one edit from the line of document 1
        3: ("nineteen bytes long", 2, 0),
        4: ("nineteen bytes lonGEr", 0, 0),  # three edits
    }
    assert line_dedup.within([b"0123456789"] * 3, [b"012345678x", b"01234567xx", b"0123456789"], np.array([1, 1, 0])).tolist() == [True, False, True]


def test_lines_of_rows_without_an_id(spark):
    common, other = "a line that all of these have", "one more line of them all"
    rows = [(None, f"{common}\nown line number {k * 1111} of {'xyz'[k % 3] * (k + 3)}\n{other}", "en", "s", 1) for k in range(6)]
    rows += [(7, f"{other}\nseven {'w' * 30}", "en", "s", 1), (7, f"{other}\nagain {'v' * 40}", "en", "s", 1)]
    df = docs_frame(spark, rows)
    kept = [r["kept"] for r in line_dedup.deduplicated(df).collect()]
    # once in all, though at the same line number of rows with the same doc_id or none
    assert sum(x.split("\n").count(common) for x in kept) == 1
    assert sum(x.split("\n").count(other) for x in kept) == 1
    assert sum(x.count("own line") for x in kept) == 6
    assert line_dedup.decisions(df).agg(F.max(F.size("drops"))).first()[0] <= 3


# --- 8: repeated byte strings -------------------------------------------------------------


def plain_repeats(rows):
    w = suffix_dedup.WINDOW
    count = {}
    for _, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - w + 1):
            count[b[i : i + w]] = count.get(b[i : i + w], 0) + 1
    out = []
    for d, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - w + 1):
            if count[b[i : i + w]] > 1:
                gone[i : i + w] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, len(b), runs, kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [2000, 1])
def test_repeats_equal_all_windows(spark, docs, empty, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)  # 1: windows are counted one by one
    found = suffix_dedup.removed(with_clashes(docs)).select("doc_id", "n_bytes", F.size("spans"), "kept")
    got = sorted(((r[0], r[1], r[2], bytes(r[3])) for r in found.collect()), key=repr)
    assert got == plain_repeats([r[:2] for r in documents()])
    assert suffix_dedup.removed(empty).count() == 0


def test_deep_shallow_order_and_extensions():
    draw = random.Random(2)
    for _ in range(200):
        pool = [bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 40))) for _ in range(12)]
        pool += [b"a" * draw.randint(0, 30) + draw.choice([b"", b"b"]) for _ in range(12)]
        left = [draw.choice(pool) for _ in range(draw.randint(1, 30))]
        right = [draw.choice(pool) for _ in left]
        order = suffix_dedup.deep_shallow_order(left)
        assert [left[i] for i in order] == sorted(left)
        need = draw.randint(0, 20)
        found = suffix_dedup.shared_extensions(left, right, need)
        for x in range(len(left)):
            pairs = {
                (suffix_dedup.common(left[x], left[y]), suffix_dedup.common(right[x], right[y]))
                for y in range(len(left))
                if y != x
            }
            for a, b in pairs:
                assert a + b < need or any(a <= c and b <= d for c, d in found[x])
            assert all(any(c <= a and d <= b for a, b in pairs) for c, d in found[x])


# --- 10 and 7: classifiers ------------------------------------------------------------------


def test_language_of_held_out_texts(docs, empty):
    model = language_id.fit(docs.filter("doc_id % 4 <> 2"))
    found = language_id.predict(with_clashes(docs), model).select("doc_id", "lang", "lang_pred", "score").collect()
    assert len(found) == len(documents())
    clear = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 120 and r["doc_id"] % 4 == 2]
    assert np.mean([r["lang"] == r["lang_pred"] for r in clear]) > 0.95
    by_id = {r["doc_id"]: r for r in found}
    for doc_id in (138, 139, 140, 141):
        assert (by_id[doc_id]["lang_pred"], by_id[doc_id]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in found)
    # nothing to learn from, and one language only
    none = language_id.fit(empty)
    assert language_id.predict(docs, none).select("lang_pred").distinct().collect() == [("und",)]
    one = language_id.fit(docs.filter("lang = 'en'"))
    assert {r[0] for r in language_id.predict(docs, one).select("lang_pred").collect()} == {"en", "und"}


def test_toxicity_of_held_out_texts(spark, empty):
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        lang = draw.choice(["en", "fr"])
        words = sentence(draw, draw.randint(10, 60), STOCK[lang]).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(draw.randrange(len(words)), draw.choice({"en": ["vile", "scum"], "fr": ["fiel", "zut"]}[lang]))
        rows.append((i, " ".join(words), lang, "s", 1))
        labels.append((i, int(toxic)))
    rows += [(500, None, "en", "s", 1), (501, "", None, None, None), (None, "x", "en", "s", 1)]
    labels += [(500, 1), (501, 0), (None, 1), (502, 1), (3, None), (7, 0), (7, 0)]
    docs = docs_frame(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    languages = language_id.fit(docs)
    model = toxicity.fit(docs, marks.filter("doc_id % 5 <> 0"), languages)
    found = {r["doc_id"]: r for r in toxicity.score(with_clashes(docs), model).collect()}
    assert len(found) == len(rows)
    held = [i for i in range(500) if i % 5 == 0]
    assert np.mean([found[i]["predicted"] == int(i % 4 == 0) for i in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found.values())
    blind = toxicity.fit(docs, marks.filter("toxic = 1"), languages)
    assert toxicity.score(docs, blind).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(empty, model).count() == 0




# --- near copies ----------------------------------------------------------------------------


def plain_near_copies(rows):
    """Rows that stay: one of each group of texts that share 0.8 of their five-word shingles."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    least = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    return sorted((r[0] for r in least), key=repr)


@pytest.mark.parametrize("pairs", [10, 0])
def test_near_copies_equal_all_pairs(spark, monkeypatch, pairs):
    from tickloom.llm import near_copies

    monkeypatch.setattr(near_copies, "PAIRS", pairs)  # 0: hubs first
    monkeypatch.setattr(near_copies, "STARS", 2)
    draw = random.Random(12)
    rows = [(i, t) for i, t in enumerate(["a b", "A  b", "b a", "", None, "one two three four five six"])]
    for f in range(6):  # families with some words changed, in documents of any similarity
        base = sentence(draw, 90, STOCK["en"]).split()
        for _ in range(12):
            words = list(base)
            for _ in range(draw.randint(0, 5)):
                words[draw.randrange(len(words))] = f"odd{draw.randint(0, 99)}"
            words = words[: len(words) - draw.randint(0, 9)]
            rows.append((None if draw.random() < 0.2 else len(rows), " ".join(words)))
    rows += [(None, "only without an id"), (None, "only without an id")]
    want = plain_near_copies(rows)
    assert len(want) < len(rows) - 20
    df = docs_frame(spark, [(i, t, "en", "s", 1) for i, t in rows])
    kept = near_copies.one_of_each(with_clashes(df).withColumn("odd name", F.struct("doc_id")))
    assert kept.columns == [*with_clashes(df).columns, "odd name"]
    assert {r["nd_root"] for r in kept.select("nd_root").distinct().collect()} == {"own"}
    found = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert found == want
    assert near_copies.one_of_each(docs_frame(spark, [])).count() == 0


def test_near_copies_go_through_fingerprints_and_parities(spark, monkeypatch):
    from tickloom.llm import near_copies

    draw = random.Random(13)
    base = sentence(draw, 400, STOCK["en"])
    near = f"{base} end"
    other = sentence(draw, 400, STOCK["en"])
    marked = near_copies._marked(docs_frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate([base, near, other])]))
    assert {r["nd_print"] for r in marked.collect()} == {simhash.fingerprint(t.encode()) for t in (base, near, other)}
    name = {r["doc_id"]: r["nd_words"] for r in marked.collect()}
    pairs = near_copies._print_pairs(marked).collect()
    assert [{*r} for r in pairs] == [{name[0], name[1]}]
    every = spark.createDataFrame([(name[0], name[1]), (name[0], name[2])], "a bigint, b bigint")
    assert [(r["a"], r["b"]) for r in near_copies._likely(every, marked).collect()] == [(name[0], name[1])]
    # what the fingerprints link is settled before the join begins
    monkeypatch.setattr(near_copies, "STARS", -1)
    assert len({r["root"] for r in near_copies._links(marked).collect()}) == 1
    # no pair of sets that agrees is ruled out
    for n in (1, 5, 60, 3_000):
        for _ in range(40):
            a = np.unique(np.random.default_rng(draw.random().__hash__() % 2**32).integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.append(a[draw.randint(0, n // 4) :], np.arange(draw.randint(0, n // 4), dtype=np.uint64)))
            bits = [np.frombuffer(near_copies.parities(x), np.uint8)[None] for x in (a, b)]
            ok = near_copies.may_agree(*bits, np.array([len(a)]), np.array([len(b)]))[0]
            assert ok or not near_copies.agree(a, b)


def test_pairs_of_long_documents_are_ruled_out_by_their_parities(spark):
    from tickloom.llm import near_copies

    draw = np.random.default_rng(14)
    bits = lambda x: np.frombuffer(near_copies.parities(x), np.uint8)[None]
    for n, m in ((2_500, 2_500), (4_000, 4_100), (9_000, 8_000)):  # of 1,024 places half are odd whatever the sets are
        a, b = (np.unique(draw.integers(0, 2**63, k).astype(np.uint64)) for k in (n, m))
        some = np.unique(np.concatenate((a[: n // 2], b[: m - n // 2])))
        for x in (b, some):
            assert not near_copies.agree(a, x)
            assert not near_copies.may_agree(bits(a), bits(x), np.array([len(a)]), np.array([len(x)]))[0]
        near = np.unique(np.append(a[n // 20 :], b[: n // 20]))
        assert near_copies.agree(a, near)
        assert near_copies.may_agree(bits(a), bits(near), np.array([len(a)]), np.array([len(near)]))[0]
    texts = [sentence(random.Random(k), 5_000, STOCK["en"]) for k in (1, 2)]
    texts += [f"{texts[0]} end", "a b c", ""]
    marked = near_copies._marked(docs_frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]))
    name = {r["doc_id"]: r["nd_words"] for r in marked.collect()}
    every = spark.createDataFrame([(name[i], name[j]) for i in range(5) for j in range(i)], "a bigint, b bigint")
    assert {(r["a"], r["b"]) for r in near_copies._likely(every, marked).collect()} == {(name[2], name[0])}


def test_few_links_are_one_task(spark):
    from tickloom.llm import graph

    draw = random.Random(16)
    for n, m in ((2, 1), (200, 150), (60, 300), (40, 0)):  # chains and crowds, links to themselves, given twice, without an end
        links = [(draw.randrange(-n, n), draw.randrange(-n, n)) for _ in range(m)]
        links += [(k, k + 1) for k in range(1_000, 1_000 + n)] + [(5, 5), (None, 1), (2, None)] + links[:3]
        table = spark.createDataFrame(links, "a bigint, b bigint")
        assert rows_of(graph.components(table, few=5_000)) == rows_of(graph.components(table))
    tasks = graph.components(table.repartition(7), few=5_000)
    assert len(tasks.inputFiles()) == 1
    assert graph.components(table.filter("a = 5"), few=5).count() == 0


def test_slices_hold_every_pair_once(spark, monkeypatch):
    from tickloom.llm import near_copies

    draw = random.Random(15)
    rows = [(k, i, 40, k % 5, i - i % 3) for i in range(60) for k in draw.sample(range(90), 12)]
    table = spark.createDataFrame(rows, "shingle bigint, id bigint, n int, at int, root bigint")
    whole = rows_of(near_copies._group_pairs(table))
    parts = [rows_of(near_copies._group_pairs(table, 4, k)) for k in range(4)]
    assert all(parts) and sorted(sum(parts, []), key=repr) == whole
    # documents beyond the fingerprints' reach, in slices of a pair or so
    monkeypatch.setattr(near_copies, "SLICE", 0)
    texts = [sentence(draw, 60, STOCK["en"]) for _ in range(12)]
    texts = [(i, t) for i, t in enumerate(x for t in texts for x in (t, f"{t} one two three four", f"five six {t}"))]
    found = near_copies.one_of_each(docs_frame(spark, [(i, t, "en", "s", 1) for i, t in texts]))
    assert sorted((r["doc_id"] for r in found.collect()), key=repr) == plain_near_copies(texts)


def test_a_written_stage_leaves_no_shuffle_files(spark):
    from tickloom.llm import common

    files = lambda: sum(
        f.getName().startswith("shuffle_")
        for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
            spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        )
    )
    held = spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count()
    setting = spark.conf.get(common.CLEANUP, None)
    before = files()
    table = common.staged(held, "left")
    for _ in range(50):  # files go a moment later
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and table.count() == 7
    assert spark.conf.get(common.CLEANUP, None) == setting


def test_sequences_of_words_with_one_hash_are_told_apart(spark):
    from tickloom.llm import near_copies

    rows = [(1, 7, 1, 10), (2, 7, 2, 20), (3, 7, 2, 30), (4, 8, 5, 40)]
    marked = spark.createDataFrame(rows, "doc_id bigint, nd_words bigint, nd_more bigint, nd_text bigint")
    name = {r["doc_id"]: r["nd_words"] for r in near_copies._told_apart(marked).collect()}
    assert name[1] != name[2] == name[3] and name[4] == 8 and len(name) == 4


def test_every_sql_is_text():
    from tickloom.llm.registry import ORACLE, QUERIES

    assert all(isinstance(sql, str) for sql in ORACLE.values()) and set(ORACLE) <= set(QUERIES)


def test_every_labelled_text_is_learned(spark):
    draw = random.Random(8)
    rows, labels = [], []
    for i in range(8_000):  # every toxic word is in sixteen texts of 4,000, too few to survive a sample of classes
        words = sentence(draw, 6, STOCK["en"]).split()
        if i % 2:
            words.insert(draw.randrange(6), f"{'bcdfg'[i // 2 % 5]}{i // 2 % 250}vile")
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, i % 2))
    docs = docs_frame(spark, [*rows, rows[1], rows[2], (8_000, "unlabelled", "en", "s", 1)])
    marks = spark.createDataFrame([*labels, (3, 0), (9_000, 1)], "doc_id bigint, toxic int")
    languages = language_id.fit(docs)
    learned = toxicity.labelled(docs, marks, languages, 1_000)
    assert learned.count() == 8_000 and learned.filter("toxic = 1").count() == 4_000
    assert learned.select("shard").distinct().count() == 8
    model = toxicity.fit(docs, marks, languages, 1_000)
    found = toxicity.score(docs, model).collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in found if r["doc_id"] < 8_000]) > 0.95
    again = toxicity.fit(docs.repartition(5), marks, languages, 1_000)
    assert all((x == y).all() for x, y in zip(model.network.parts, again.network.parts))
    assert model.thresholds == again.thresholds and model.pooled == again.pooled
