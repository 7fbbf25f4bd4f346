"""Token alignment, dataset manifest and license scan against plain versions, with the hard cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from tests.llm.cases import docs_frame, documents, with_clashes
from tickloom.llm import dataset_manifest, licenses, token_alignment


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return docs_frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_frame(spark, []).cache()


# --- 11: alignment ----------------------------------------------------------------------

ODD = [
    (900, "a▁b as plain text", "en", "src0", 1),
    (901, "<|endoftext|> <s> </s> <0x41>", "en", "src0", 1),
    (902, "tabs\tand  many   spaces \n\n end ", "en", "src0", 1),
    (903, "日本語 😀 ﬁ é́ \u0000 x", "en", "src0", 1),
    (904, " ", "en", "src0", 1),
]


def plain_alignment(rows):
    """Pairs by comparing all spans; counts by sets."""
    first, second = token_alignment.opened(token_alignment.model_paths())
    per_row, held = [], Counter()
    for doc_id, text in rows:
        ids = [tool.encode([text or ""])[0] for tool in (first, second)]
        want = b" " + (text or "").encode()
        if not text or any(b"".join(t.tokens[i] for i in x) != want for t, x in zip((first, second), ids)):
            per_row.append((doc_id, [], [], [], []))
            continue
        spans = []
        for tool, side in zip((first, second), ids):
            ends = list(itertools.accumulate(len(tool.tokens[i]) for i in side))
            spans.append(list(zip([0, *ends], ends, side)))
        linked = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        both = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups = [
            [[t[2] for t in side if lo < t[1] <= hi] for side in spans] for lo, hi in zip([0, *both], both)
        ]
        per_row.append((doc_id, *ids, groups, linked))
        held.update(set(linked))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for doc_id, a, b, groups, linked in per_row:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append(
            (doc_id, len(a), len(b), len(groups), len(linked), text)
            + (sum(held[x] == best[x[0]] for x in linked), sum(held[x] for x in linked))
        )
    return out


@pytest.mark.parametrize("chunk", [2_000_000, 700])
def test_alignment_equals_all_spans(spark, monkeypatch, chunk):
    monkeypatch.setattr(token_alignment, "CHUNK_BYTES", chunk)
    rows = [r for r in documents() if r[0] is None or r[0] % 3 != 1 or r[0] > 125] + ODD
    found = token_alignment.aligned(docs_frame(spark, rows), token_alignment.model_paths(), with_groups=True)
    names = "doc_id n_a n_b n_groups n_links groups n_best count_sum".split()
    want = plain_alignment([r[:2] for r in rows])
    assert rows_of(found.select(names)) == sorted(want, key=repr)
    assert found.filter("groups_sha256 <> CASE WHEN groups = '' THEN '' ELSE sha2(groups, 256) END").count() == 0
    zero = {r[0] for r in found.filter("n_a = 0").collect()}
    assert {138, 139, 900} <= zero and 901 not in zero and 902 not in zero


def test_alignment_of_nothing(docs, empty):
    assert token_alignment.aligned(empty, token_alignment.model_paths()).count() == 0
    only_null = docs.filter("text IS NULL OR text = ''")
    found = token_alignment.aligned(with_clashes(only_null), token_alignment.model_paths())
    assert {tuple(r)[1:] for r in found.collect()} == {(0, 0, 0, 0, "", 0, 0)}


# --- 12: manifest -----------------------------------------------------------------------


def plain_manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def lowered(t):
        return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def climb(tree, at):
        """Levels of siblings left and right, and the last hash."""
        steps = []
        while len(tree) > 1:
            lo = at // 16 * 16
            steps.append((tree[lo:at], tree[at + 1 : lo + 16]))
            tree = [sha("".join(tree[i : i + 16])) for i in range(0, len(tree), 16)]
            at //= 16
        return steps, tree[0]

    by_source = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf, other = (sha("".join(map(field, (doc_id, source, lang, n_chars, t)))) for t in (text, lowered(text)))
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        by_source[source].append((doc_id, leaf, other if tampered else leaf, tampered))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    tops = [climb([r[1] for r in by_source[s]], 0)[1] for s in order]
    out = []
    for k, s in enumerate(order):
        above, root = climb(tops, k)
        for at, (doc_id, leaf, now, tampered) in enumerate(by_source[s]):
            steps, subroot = climb([r[1] for r in by_source[s]], at)
            h, copies = now, [now]
            for left, right in steps + above:
                h = sha("".join([*left, h, *right]))
                copies.append(h)
            proof = sha("".join(x for left, right in steps + above for x in left + right))
            out.append((doc_id, leaf, subroot, root, proof, h, h == root, copies if tampered else []))
    return out


def tree_rows():
    draw = random.Random(8)
    rows = documents()
    rows += [(i, draw.choice(["Upper", "lower", "MiXed"]) * draw.randint(0, 3), "en", "big", i) for i in range(1000, 1700)]
    rows += [(i, "T", "en", f"s{i}", None) for i in range(2000, 2040)]  # many sources of one row
    rows += [(i, "T", None, "sixteen", None) for i in range(3000, 3016)]
    rows += [(7, "same", "en", "Ärger", 4)] * 300  # one key, one text
    rows += [(i, "x", "en", "", 4) for i in range(4000, 4003)]  # an empty source is not a null one
    return rows


@pytest.mark.parametrize("levels", [2, 1])
def test_manifest_equals_plain_trees(spark, monkeypatch, levels):
    monkeypatch.setattr(dataset_manifest, "BLOCK_LEVELS", levels)
    frame = with_clashes(docs_frame(spark, tree_rows()))
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    found = dataset_manifest.manifest(frame, dataset_manifest.lowered(F.col("text")), picked, with_nodes=True)
    names = "doc_id leaf subroot root proof_sha256 folded_root verified copies".split()
    assert rows_of(found.select(names)) == sorted(plain_manifest(tree_rows()), key=repr)
    assert found.filter("sha2(concat_ws('', siblings), 256) <> proof_sha256").count() == 0


def test_manifest_of_nothing_and_of_one(spark, empty, docs):
    low = dataset_manifest.lowered(F.col("text"))
    assert dataset_manifest.manifest(empty, low, F.lit(True)).count() == 0
    (one,) = dataset_manifest.manifest(docs.filter("doc_id = 3"), low, F.lit(False)).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha("") and one.verified


def test_versions_share_untouched_nodes():
    leaves = [sha(str(i)) for i in range(200)]
    tree = dataset_manifest.PersistentTree(leaves, 2)
    before = len(tree.hashes)
    versions = [tree.replaced(at, sha("other"))[-1] for at in range(200)]
    assert len(tree.hashes) == before + 200 * 3  # a leaf, its run and the top
    assert tree.kids[versions[17]][2:] == tree.kids[tree.top][2:] and tree.kids[versions[17]][1] != tree.kids[tree.top][1]
    assert [tree.hashes[k] for k in range(200)] == leaves


# --- 13: licences -----------------------------------------------------------------------

TEXTS = [
    "Released under the MIT License. mit--LICENSE! mit license",
    "the MIT\n\nLicense; Apache License; GNU Lesser General Public License",
    "submit license mitlicense mit licenses",
    "Licensed under CC BY-NC 4.0",
    "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nmore",
    "SPDX-License-Identifier: GPL-3.0-or-later WITH GCC-exception-3.1 */",
    "SPDX-License-Identifier: MIT AND (\nSPDX-License-Identifier: Apache-2.0.",
    "spdx license identifier MIT",
    "Ümit license émit license mit license",
    "général public license general PUBLIC license",
    "mit license " * 3000,
]


def license_rows():
    return documents() + [(5000 + i, t, "en", "src0", None) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], None, None, 1)]


def plain_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [
        (i, label)
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    at = [i for i, _ in found]
    labels = ",".join(sorted({x for _, x in found}))
    return len(words), len(found), min(at, default=None), max(at, default=None), labels


def test_licences_equal_plain_search(spark, empty):
    found = licenses.summary(licenses.scan(docs_frame(spark, license_rows())))
    names = "doc_id n_words n_base first_word last_word base_labels".split()
    want = [(r[0], *plain_base(r[1])) for r in license_rows()]
    assert rows_of(found.select(names)) == sorted(want, key=repr)
    labels = {r.doc_id: (set(r.labels.split(",")), r.score) for r in found.filter("doc_id >= 5000").collect()}
    assert labels[5001][0] == {"mit", "apache", "gpl", "lgpl"}
    assert labels[5002] == ({""}, 0.0)
    assert labels[5003] == ({"cc-by-nc"}, 0.5)
    assert labels[5004][0] == {"mit", "gpl-2.0-only", "apache-2.0", "permissive"}
    assert labels[5005][0] == {"gpl-3.0-or-later", "weak-copyleft"}
    assert labels[5006][0] == {"malformed", "apache-2.0", "permissive"}
    assert labels[5007] == ({""}, 0.0)
    assert found.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert licenses.summary(licenses.scan(empty)).count() == 0


def test_scan_keeps_columns_and_replaces_its_own(docs):
    found = licenses.scan(with_clashes(docs).withColumn("places", F.lit("own")))
    assert found.count() == docs.count()
    assert found.select("score", "fp").distinct().collect() == [("own", "own")]
    assert dict(found.dtypes)["n_words"] == "bigint" and dict(found.dtypes)["places"].startswith("array")


def plain_level(expression):
    """Levels by Python's own reading: lax side of or, strict side of and."""
    class Level:
        def __init__(self, n):
            self.n = n

        def __or__(self, other):
            return Level(min(self.n, other.n))

        def __and__(self, other):
            return Level(max(self.n, other.n))

    tokens = [{"OR": "|", "AND": "&"}.get(t, t) for t in expression.split()]
    text = " ".join(t if t in "|&()" else f"Level({licenses.strictness(t)})" for t in tokens)
    return licenses.LEVELS[eval(text, {"Level": Level}).n]  # noqa: S307 - text made here


def test_expressions_equal_another_reading():
    draw = random.Random(3)
    names = ["MIT", "GPL-2.0-only", "MPL-2.0", "CC0-1.0", "Apache-2.0", "CC-BY-NC-4.0"]

    def make(depth):
        if depth == 0 or draw.random() < 0.3:
            return draw.choice(names)
        inner = f"{make(depth - 1)} {draw.choice(['AND', 'OR'])} {make(depth - 1)}"
        return f"( {inner} )" if draw.random() < 0.5 else inner

    for _ in range(300):
        expression = make(4)
        level, found = licenses.parsed(expression)
        assert level == plain_level(expression)
        assert found == list(dict.fromkeys(t.lower() for t in expression.split() if t not in ("AND", "OR", "(", ")")))
    assert licenses.parsed("GPL-2.0-only WITH Classpath-exception-2.0 OR CC-BY-NC-4.0")[0] == "weak-copyleft"
    for bad in ("", "MIT AND", "OR MIT", "( MIT", "MIT )", "MIT Apache-2.0", "( )", "MIT WITH ( A OR B )"):
        assert licenses.parsed(bad) == ("malformed", [])
    assert licenses.parsed("( " * 50_000 + "MIT" + " )" * 50_000)[0] == "permissive"
