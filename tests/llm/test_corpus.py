"""The corpus operators against brute force, and on odd input."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sonolith.llm import classlm, decontaminate, fingerprints, langid, licenses, linededup, mixing, neardup, suffixes, textvec, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = {"en": "the of and to in that is with river stone light house".split(), "fr": "le la de et que une dans avec rivière pierre été maison".split()}
    line = lambda lang, k: " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "", "s", str(rng.randrange(40))]) for _ in range(k))
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        rows.append([i, "\n".join(line(lang, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 9))), lang, rng.choice(["a", "a", "a", "b", None]), 0])
    passage = "\n".join(line("en", 25) for _ in range(6))
    for i in range(0, n, 7):
        rows[i][1] = rows[i][1] + "\n" + passage + "\n" + line("en", 5)
    for i in range(1, n, 9):
        rows[i][1] = rows[(i * 5) % n][1]
    for i in range(2, n, 11):
        base = rows[(i * 3) % n][1].split(" ")
        base[len(base) // 2] = "changed"
        rows[i][1] = " ".join(base)
    rows += [[n, None, "en", "a", 0], [n + 1, "", None, "a", 0], [n + 2, " \n\t ", "fr", None, 0], [n + 3, "one", "en", "b", 0], [n + 4, "12 34 !!", None, "c", 0], [None, rows[3][1], "en", "a", 0]]
    rows.append(list(rows[5]))
    rows.append([n + 5, "z" * 3000 + " " + "ab " * 3000, "en", "a", 0])
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    # columns of a caller whose names operators use themselves
    return df.withColumns({c: F.lit("x") for c in ("row", "node", "label", "key", "size", "hits", "rank", "bucket", "copies")}).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def union_find(pairs, items):
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in items}


@pytest.mark.parametrize("k", [4, 5])
def test_near_groups(spark, rows, docs, empty, k):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    home = union_find(links, range(len(rows)))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[home[i]] = min(least.get(home[i], 1 << 60), r[0])
    want = Counter((r[0], len(sets[i]), least.get(home[i]), r[0] == least.get(home[i])) for i, r in enumerate(rows))
    got = Counter(tuple(r) for r in neardup.groups(docs, shingle=k).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == want
    assert neardup.groups(empty, shingle=k).count() == 0


def test_recall_near_the_threshold(spark):
    """Many pairs at a similarity from 0.80 to 0.83, alone and as families with a common leader: nearly all links must be found."""
    rng = random.Random(11)
    texts, want = [], []

    def variant(base, changed):
        """The words with the last ones changed: each takes one shingle."""
        return base[: len(base) - changed] + [f"v{rng.randrange(10**9)}" for _ in range(changed)]

    for i in range(400):
        base = [f"w{rng.randrange(10**9)}" for _ in range(104)]
        shingles = 100
        changed = 10 + (i % 2)  # 2 * c / (1 - c) ... : 90 of 110 shared at 10, 89 of 111 at 11
        shared = shingles - changed
        assert shared / (2 * shingles - shared) >= 0.8
        want.append((len(texts), len(texts) + 1))
        texts += [base, variant(base, changed)]
    base = [f"w{rng.randrange(10**9)}" for _ in range(104)]
    first = len(texts)
    texts += [variant(base, 10) for _ in range(60)] + [base]
    want += [(j, len(texts) - 1) for j in range(first, len(texts) - 1)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[a] == got[b] for a, b in want)
    assert found >= 0.99 * len(want)


def test_near_groups_of_a_large_family(spark):
    """Hundreds of near copies of one text: chains of small edits must end in one group, texts that only share a passage must not."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(200):
        own = list(base)
        for _ in range(1 + i % 3):
            own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    for _ in range(60):
        texts.append(" ".join(base[:70] + [f"y{rng.randrange(10**6)}" for _ in range(70)]))
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert got == union_find(links, range(len(rows)))


def test_suffix_dedup(rows, docs, empty):
    raws = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[i : i + 400] for _, b in raws for i in range(len(b) - 399))
    want = Counter()
    for d, b in raws:
        covered = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                covered[i : i + 400] = b"\1" * 400
        kept = bytes(c for c, gone in zip(b, covered, strict=True) if not gone)
        want[d, len(b), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest()] += 1
    got = Counter(tuple(r) for r in suffixes.dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert sum(k[2] for k in want) > 0
    assert got == want
    assert suffixes.dedup(empty).count() == 0


@pytest.mark.parametrize("hot", [50_000, 1, 6])
def test_suffix_dedup_of_hot_passages(spark, monkeypatch, hot):
    """A passage in many documents, cut at different places, and a periodic text, against every window's bytes; hot keys and merged ranges alike."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    passage, other = text(1300), text(900)
    texts = []
    for i in range(40):
        a, b = (0, 1300) if i % 3 else sorted(rng.sample(range(1300), 2))
        texts.append(text(rng.randrange(300)) + passage[a:b] + text(rng.randrange(300)) + (other[:700] if i % 4 == 0 else other[200:] if i % 4 == 1 else ""))
    texts += ["xyz " * 400, "xyz " * 101 + text(50), text(2000), "", passage, passage, "é" * 300 + passage[:500]]
    raw = [t.encode() for t in texts]
    seen = Counter(r[i : i + 400] for r in raw for i in range(len(r) - 399))
    want = {}
    for d, r in enumerate(raw):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - 399):
            if seen[r[i : i + 400]] > 1:
                gone[i : i + 400] = True
        gone = gone[: len(r)]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum())
        want[d] = (len(r), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest())
    got = suffixes.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_suffix_runs_merge_in_order():
    rng = random.Random(3)
    every, blocks = [], []
    for r in range(5):
        entries = {}
        for i in range(40):
            right = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60)))
            entries[right, b"l" * rng.randrange(3), 0] = [(r, i)]
        every += list(entries)
        blocks += [b for _, b in suffixes.front_coded(entries, [])]
    out = [(lcp, right) for lcp, right, *_ in suffixes.merge(blocks)]
    assert [x for _, x in out] == sorted(e[0] for e in every)
    for (_, a), (lcp, b) in zip(out, out[1:], strict=False):
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp == n


def test_line_dedup(spark, rows, docs, empty):
    found = {}
    for r in linededup.dedup(docs).collect():
        found.setdefault((r["doc_id"], r["source"]), []).append(r)
    assert sum(len(v) for v in found.values()) == len(rows)
    plain = {}
    for r in spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", linededup.chunks(F.col("text")).alias("chunks")).collect():
        plain.setdefault((r["doc_id"], r["text"]), r["chunks"])
    bodies = {}
    for r in rows:
        chunks = plain[r[0], r[1]] or []
        assert "\n".join(c["body"] for c in chunks) == (r[1] or "")
        for at, c in enumerate(chunks):
            if c["n_lines"] >= 2 and words(c["body"]):
                bodies.setdefault(c["body"], []).append((r[0], at))
    removed = 0
    for r in rows:
        keep, seen = [], set()
        for c in plain[r[0], r[1]] or []:
            own = bodies.get(c["body"], [])
            first = min((d for d, _ in own if d is not None), default=None)
            if len(own) > 1 and (r[0] != first or c["body"] in seen):
                removed += c["n_lines"]
            else:
                keep.append(c["body"])
            seen.add(c["body"])
        assert any((x["text"] or "") == "\n".join(keep) for x in found[r[0], r[3]])
    assert removed and removed == sum(x["line_dedup"]["n_removed_lines"] for v in found.values() for x in v)
    assert linededup.dedup(empty).count() == 0


def test_line_dedup_of_passages(spark, rows, docs, empty):
    """Every line of a later copy of two lines or more goes, whatever stands around it."""
    rng = random.Random(8)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(6))
    planted, texts = [[line() for _ in range(2 + i % 5)] for i in range(40)], []
    for i in range(160):
        own = [line() for _ in range(rng.randrange(8))]
        at = rng.randrange(len(own) + 1)
        texts.append(own[:at] + planted[i % 40] + own[at:])
    odd = [["a"] * 4, ["b", "b", "c", "b", "b", "c"], ["", "", "", ""], ["alone"], ["x", "alone", "y"]]
    many = [(i, "\n".join(t)) for i, t in enumerate(texts + odd)] + [(None, "\n".join(texts[3])), (160, "\n".join(odd[1])), (7, texts[7][0])] + [(1000 + r[0] if r[0] is not None else None, r[1]) for r in rows]

    def first_places(doc, text):
        return {p: (doc, i) for i, p in reversed(list(enumerate(zip(text.split("\n"), text.split("\n")[1:], strict=False)))) if any(words(x) for x in p)}

    count, first = Counter(), {}
    for d, t in many:
        lines = (t or "").split("\n")
        count.update(p for p in zip(lines, lines[1:], strict=False) if any(words(x) for x in p))
        for p in first_places(d, t or ""):
            first[p] = min(first.get(p, math.inf), math.inf if d is None else d)
    want = Counter()
    for d, t in many:
        lines, own, gone = (t or "").split("\n"), first_places(d, t or ""), set()
        for i, p in enumerate(zip(lines, lines[1:], strict=False)):
            if count[p] > 1:
                if first[p] != (math.inf if d is None else d):
                    gone |= {i, i + 1}
                elif i > own[p][1]:
                    gone |= {i + 1} if i == own[p][1] + 1 else {i, i + 1}
        want[d, None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)] += 1
    got = linededup.dedup_runs(spark.createDataFrame(many, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r["doc_id"], r["text"], r["line_dedup"]["n_removed_lines"]) for r in got) == want
    assert all(sum(s["n_lines"] for s in r["line_dedup"]["removed"]) == r["line_dedup"]["n_removed_lines"] for r in got)
    later = {r["doc_id"]: r["text"].split("\n") for r in got if r["doc_id"] is not None and 40 <= r["doc_id"] < 160}
    assert all(set(planted[i % 40]).isdisjoint(t) for i, t in later.items())
    assert linededup.dedup_runs(docs).count() == len(rows)
    assert linededup.dedup_runs(empty).count() == 0


def test_decontamination(spark, rows, docs, empty):
    items = [(0, " ".join(words(rows[7][1])[3:40])), (1, "never seen words in any document at all here"), (2, "one"), (3, None), (4, ""), (5, rows[14][1][:200].upper())]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit(1))

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    want = {}
    for d, text, *_ in rows:
        for i, t in items:
            q = shingles(t)
            if q and len(q & shingles(text)) >= 0.8 * len(q):
                want[d, i] = (len(q), len(q & shingles(text)))
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_shared"]) for r in decontaminate.contaminated(docs, table).collect()}
    assert got == want and got
    assert decontaminate.contaminated(empty, table).count() == 0
    assert decontaminate.contaminated(docs, table.where("false")).count() == 0
    kept = {r["doc_id"] for r in decontaminate.clean(docs, table).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in got}


def test_short_items_inside_long_documents(spark):
    items = [(0, "Blue  moon"), (1, "one"), (2, "a b c d"), (3, "w1 w2 w3 w4 w5 w6"), (4, "c d a"), (5, "")]
    texts = ["x blue\nMoon y z u v", "blue x moon y z u v", "blue moon", "none", "p one", "a b c d", "a b c d a b c d", "w0 w1 w2 w3 w4 w5 w6 one", "a b c", None, ""]
    got = {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in decontaminate.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(0, 0, 1, 1), (2, 0, 1, 1), (4, 1, 1, 1), (5, 2, 1, 1), (6, 2, 1, 1), (6, 4, 1, 1), (7, 1, 1, 1), (7, 3, 2, 2)}


def test_items_are_found_through_their_sketches_only(spark, monkeypatch):
    """Without its sketch an item isn't found; a sketch is a small part of a long item, and never misses at the threshold."""
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30 + i))) for i in range(12)]
    texts = []
    for i, t in items:
        w = t.split()
        held = w[: -(-len(w) * 9 // 10)]
        texts.append((i, " ".join([f"x{rng.randrange(10**6)}" for _ in range(3000)] + held + ["y"] * 2000)))
    docs, table = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    sizes = {r["item_id"]: (r["n"], r["k"]) for r in decontaminate.item_shingles(table).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_sketch").alias("k")).collect()}
    assert all(k <= 0.45 * n for n, k in sizes.values())
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, table).collect()} == {(i, i) for i, _ in items}
    own = decontaminate.item_shingles
    monkeypatch.setattr(decontaminate, "item_shingles", lambda *a: own(*a).withColumn("in_sketch", F.col("in_sketch") & (F.col("item_id") != 4)))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, table).collect()} == {(i, i) for i, _ in items if i != 4}


def test_decontamination_by_shuffle(docs, spark, monkeypatch):
    table = spark.createDataFrame([(0, "the of and to in that is with")], "item_id long, text string")
    near = decontaminate.contaminated(docs, table).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    assert decontaminate.contaminated(docs, table).collect() == near


def water_fill(sizes, weights, cap):
    target, open_ = {}, dict(sizes)
    rest = float(sum(sizes.values()))
    while open_:
        level = rest / sum(weights[s] for s in open_)
        full = [s for s in open_ if cap * open_[s] < level * weights[s]]
        if not full:
            return target | {s: level * weights[s] for s in open_}
        for s in full:
            target[s] = cap * open_.pop(s)
            rest -= target[s]
    return target


def test_mixing(rows, docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted(s for s in sizes if s is not None) + [None]
    want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 3)
    for s in names:
        own = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-5 and r["source_size"] == sizes[s] for r in own)
        assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 3 * max(r["size"] for r in own) + 1
    key = lambda r: (r["doc_id"] is not None, r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, mixing.mix(docs.repartition(5)).collect())) == sorted(map(key, got))
    assert mixing.mix(empty).count() == 0


def test_fingerprints(rows, docs, empty):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    for r, after in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, n = r[1] or "", len(r[1] or "")
        edited = text[: n - n // 4] + (after[1] or "")[: n // 4]
        own, changed, following = fingerprints.fingerprints([text.encode(), edited.encode(), (after[1] or "").encode()])
        want[r[0], n, hashlib.sha256(edited.encode()).hexdigest(), own, changed, fingerprints.likeness(own, changed), fingerprints.likeness(own, following)] += 1
    got = fingerprints.edited_fingerprints(docs).collect()
    assert Counter(tuple(r) for r in got) == want
    assert all(r["near_edited"] > 0.4 for r in got if 100 < r["n_chars"] < 12_000)
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_neighbours_over_many_ranges(rows, docs, monkeypatch):
    before = sorted(map(str, fingerprints.edited_fingerprints(docs).collect()))
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 5)
    assert sorted(map(str, fingerprints.edited_fingerprints(docs).collect())) == before


def test_likeness_of_edits():
    rng = random.Random(2)
    text = " ".join(f"word{rng.randrange(5000)}" for _ in range(800))
    other = " ".join(f"term{rng.randrange(5000)}" for _ in range(800))
    moved = text[:2000] + " inserted words here " + text[2000:]
    a, b, c = fingerprints.fingerprints([text.encode(), moved.encode(), other.encode()])
    assert fingerprints.likeness(a, a) == 1.0 and fingerprints.likeness(a, b) > 0.85 and fingerprints.likeness(a, c) < 0.1
    naive = lambda x, y: max((naive_lcs(x, y),))

    def naive_lcs(x, y):
        table = [0] * (len(y) + 1)
        for p in x:
            last = 0
            for j, q in enumerate(y):
                last, table[j + 1] = table[j + 1], last + 1 if p == q else max(table[j + 1], table[j])
        return table[-1]

    x, y = a.split(":")[1], b.split(":")[1]
    assert fingerprints.common(x, y) == naive(x, y)


def test_token_counts(rows, docs, empty):
    from tokenizers import Tokenizer, models

    pieces = tokens.read_pieces(MODEL)
    least = min(s for _, s, k in pieces if k == 1)
    library = Tokenizer(models.Unigram([(p, s if k == 1 else least) for p, s, k in pieces], unk_id=0, byte_fallback=True))
    library_count = lambda t: len(library.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0
    got = Counter((r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(docs, pieces).collect())
    assert got == Counter((r[0], library_count(r[1])) for r in rows)
    assert tokens.token_counts(empty, pieces).count() == 0
    counter = tokens.Counter(pieces)
    for text in ("  two  spaces ", "日本語 text\n\nnew", "emoji 🎉🎉", "a\tb", "é" * 50):
        assert counter.count(text)[0] == library_count(text)


def test_token_ties():
    """Equal scores: the earliest start, so the longest last piece, wins; unknown characters fuse without byte pieces."""
    pieces = [("a", -1.0, 1), ("b", -1.0, 1), ("c", -1.0, 1), ("ab", -2.0, 1), ("bc", -2.0, 1), ("abc", -3.0, 1), ("▁", -1.0, 1)]
    counter = tokens.Counter(pieces, prefix=False)
    assert counter.count("abc") == (1, -3.0)
    assert counter.count("bcbc") == (2, -4.0)
    assert counter.count("xxa")[0] == 2


def test_language_id(spark, docs, rows, empty):
    rng = random.Random(9)
    vocabulary = {"en": "the of and to in that is with river stone light house".split(), "fr": "le la de et que une dans avec rivière pierre été maison".split(), "de": "der die und das nicht ein mit haus stein fluß licht über".split()}
    many = [(i, " ".join(rng.choice(vocabulary[x]) for _ in range(rng.randrange(5, 60))), x, "s", 0) for i in range(300) for x in [("en", "fr", "de")[i % 3]]]
    table = spark.createDataFrame(many, SCHEMA)
    got = {r["doc_id"]: r for r in langid.languages(table).collect()}
    assert len(got) == 300
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    apart = [d for d, r in got.items() if r["held_out"]]
    assert sum(got[d]["lang_pred"] == many[d][2] for d in apart) / len(apart) > 0.97
    model = langid.fit(table)
    mixed = spark.createDataFrame([(0, " ".join(vocabulary["en"] + vocabulary["de"])), (1, None), (2, ""), (3, "12 34 !!"), (4, "€ ½")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in langid.predict(mixed, model, runs=True).collect()}
    assert [r["lang"] for r in out[0]["runs"]] == ["en", "de"]
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1, 2, 3, 4))
    assert len(langid.languages(docs).collect()) == len(rows)
    assert langid.languages(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.languages(unlabelled).collect()} == {"und"}


def test_language_sample_is_bounded(spark):
    """A million rows of one id would all share a hash of the id: the sample is numbered, too."""
    rows = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the of and to in").alias("text"), F.lit("en").alias("lang"))
    seen = []
    own = langid.train
    try:
        langid.train = lambda texts, langs, **k: seen.append(len(texts)) or own(texts[:3], langs[:3])
        langid.fit(rows, sample=20)
    finally:
        langid.train = own
    assert seen[0] <= 40


def test_language_training_holds_different_words_once():
    rng = random.Random(4)
    of = {x: [x + "".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(500)] for x in ("xe", "yf")}
    texts = [(x, " ".join(rng.choices(of[x], k=300))) for x in of for _ in range(200)]  # 120,000 words, 1,000 different ones
    langid.train(["a"], ["xe"])
    textvec.powers(1)
    tracemalloc.start()
    try:
        model = langid.train([t for _, t in texts], [x for x, _ in texts])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64e6, peak
    piece = next(textvec.pieces(pa.array([" ".join(of["xe"]), " ".join(of["yf"])])))
    assert langid.decide(model, piece, False)[0] == ["xe", "yf"]


def test_chain_by_blocks_is_exact():
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    scores, first = rng.normal(size=(97, 3)), rng.random(97) < 0.1
    first[0] = True
    got = langid.marginals(model, scores, first)
    for a, b in zip(np.flatnonzero(first), [*np.flatnonzero(first)[1:], 97], strict=True):
        p, move = np.exp(scores[a:b]), np.exp(model.transitions)
        ahead, back = [np.exp(model.initial) * p[0]], [np.ones(3)]
        for t in range(1, b - a):
            ahead.append(ahead[-1] @ move * p[t])
        for t in range(b - a - 1, 0, -1):
            back.insert(0, move @ (p[t] * back[0]))
        both = np.array(ahead) * np.array(back)
        assert np.allclose(got[a:b], both / both.sum(axis=1, keepdims=True))


def test_class_lm(rows, docs, empty, monkeypatch):
    monkeypatch.setattr(classlm, "HEAD", 20)  # so that most words go by the join
    apart = langid.held_out(fold=2, folds=7)
    model, rare = classlm.fit(docs.where(~apart))
    got = classlm.score(docs, model, rare).collect()
    train, held = Counter(), lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    for r in rows:
        if not held(r[0]):
            train.update([*words(r[1]), None])
    n, v = sum(train.values()), len(train)
    want = Counter()
    for r in rows:
        w = [*words(r[1]), None]
        want[r[0], len(w), sum(train[x] > 0 for x in w), n, round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    one = classlm.fit_and_score(docs, ~apart)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["learn"], round(r["score"], 6)) for r in one.collect()) == Counter((r["doc_id"], r["n_tokens"], r["n_known"], not held(r["doc_id"]), round(r["score"], 6)) for r in got)
    assert classlm.fit_and_score(empty, ~apart).count() == 0
    model, rare = classlm.fit(empty)
    assert all(r["base_score"] == 0 and r["n_known"] == 0 for r in classlm.score(docs, model, rare).collect())
    assert classlm.score(empty, model, rare).count() == 0


@pytest.mark.parametrize("head", [1 << 17, 20])
def test_class_lm_is_a_distribution(docs, monkeypatch, head):
    """Transitions of a class sum to one, and a class's emissions with its unseen word do, too; words beyond the head change nothing."""
    whole, none = classlm.fit(docs)
    monkeypatch.setattr(classlm, "HEAD", head)
    model, rare = classlm.fit(docs)
    assert np.allclose((10**model.transitions).sum(axis=1), 1)
    mass = np.bincount(model.head_class, model.head_count + 1.0, minlength=classlm.CLASSES + 1)
    words_of = {int(w): int(c) for w, c in zip(model.head.view(np.int64), model.head_class, strict=True)}
    for r in rare.collect():
        if r["class"] is not None:
            mass[r["class"]] += r["n"] + 1
            words_of[r["word"]] = r["class"]
        else:
            assert r["n"] < classlm.FLOOR
            mass += 0.0
    unclassed = [r["n"] + 1 for r in rare.collect() if r["class"] is None]
    assert math.isclose((10**model.norms[: classlm.CLASSES] - 1).sum(), mass.sum() + sum(unclassed), rel_tol=1e-9)
    if head == 1 << 17:
        assert np.allclose(10**model.norms[: classlm.CLASSES], mass[: classlm.CLASSES] + 1)
    assert (model.tokens, model.types) == (whole.tokens, whole.types)


def test_class_lm_beyond_the_head(spark, monkeypatch):
    """The same scores, whether words travel or are joined by their places."""
    def scores():
        model, rare = classlm.fit(docs)
        return sorted((r["n_tokens"], round(r["score"], 6)) for r in classlm.score(docs, model, rare).collect())

    rng = random.Random(2)
    many = [" ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(400)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")
    whole = scores()
    monkeypatch.setattr(classlm, "HEAD", 1100)
    assert scores() == whole


def test_words_go_where_their_contexts_fit(spark):
    moves = np.ones((classlm.CLASSES + 1, classlm.CLASSES + 1))
    moves[3, 7] = moves[7, 5] = 500.0
    both = classlm.SLOTS + 3 * (classlm.CLASSES + 1) + 5
    found = spark.createDataFrame([(1, False, [(3, 2), (classlm.CLASSES + 1 + 5, 2)]), (2, True, [(both, 1)])], "key long, far boolean, slots array<struct<slot: int, n: long>>")
    assert [r["class"] for r in classlm.best_classes(found, moves).collect()] == [7, 7]


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(1)
    n = 41
    group = rng.integers(0, 4, n)
    counts = rng.poisson(np.where(group[:, None] == (group[None, :] + 1) % 4, 30, 1))
    own = classlm.exchange(counts, classes=4, rounds=8)

    def likelihood(classes):
        member = np.eye(5)[classes]
        table = member.T @ counts @ member
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(table) - f(table.sum(axis=0)) - f(table.sum(axis=1))

    start = np.arange(n) % 4
    start[-1] = 4
    best = group.copy()
    best[-1] = 4
    assert likelihood(own) >= max(likelihood(start), 0.999 * likelihood(best) if likelihood(best) > 0 else 1.001 * likelihood(best))


def test_licenses(spark, docs, rows, empty):
    files = [
        (0, "p/LICENSE", "Released under the MIT License.\nmore text follows here"), (1, "p/src/a.py", "some code"), (2, "p/src/deep/b.py", "x = 1 + 2 + 3 + 4 + 5 + 6 + 7 + 8 + 9\nLicensed under the Apache License, Version 2.0."),
        (3, "p/src/deep/c.py", "other code"), (4, "q/d.py", "nothing"), (5, None, "Released under the MIT License."), (6, "p/e.py", None), (7, "p/src/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."),
        (8, "pp/f.py", "no license text is here but the word"), (9, None, None), (0, "p/LICENSE", "Released under the MIT License.\nmore text follows here"),
    ]
    got = {r["doc_id"]: (r["license"], r["origin"], r["from_dir"]) for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("term", F.lit(1))).collect()}
    assert got == {
        0: ("MIT", "declared", None), 1: ("GPL-3.0", "inherited", "p/src"), 2: ("Apache-2.0", "declared", None), 3: ("GPL-3.0", "inherited", "p/src"), 4: (None, "none", None), 5: ("MIT", "declared", None),
        6: ("MIT", "inherited", "p"), 7: ("GPL-3.0", "declared", None), 8: (None, "none", None), 9: (None, "none", None),
    }
    files = docs.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    assert licenses.scan(files).count() == len(rows)
    assert licenses.scan(files.where("false")).count() == 0


def units_of(text, path):
    """Plain version: terms of each line, paragraph, comment block and license file."""
    lines = (text or "").lower().split("\n")
    terms = [re.findall(licenses.TERM, x) for x in lines]
    out = list(terms)
    for inside in ([bool(t) for t in terms], [bool(re.match(licenses.COMMENT, x)) for x in lines]):
        run = []
        for i in [*range(len(lines)), None]:
            if i is not None and inside[i]:
                run.append(i)
                continue
            if len(run) > 1:
                out.append([t for j in run for t in terms[j]])
            run = []
    if path and re.search(licenses.LICENSE_FILE, path):
        out.append([t for x in terms for t in x])
    return out


def best_license(text, path, templates):
    weights, unknown = licenses.template_weights(templates)
    idf = {t: i for _, _, t, _, i in weights}
    best = (0.0, "")
    for terms in units_of(text, path):
        n = {t: (1 + math.log(c)) * idf.get(t, unknown) for t, c in Counter(terms).items()}
        norm = math.sqrt(sum(w * w for w in n.values()))
        scores = Counter()
        for form, name, t, w, _ in weights:
            scores[form, name] += n.get(t, 0.0) * w / norm if norm else 0.0
        best = min([best, *((-round(x, 9), name) for (_, name), x in scores.items())])
    return (best[1], -best[0]) if -best[0] >= licenses.COSINE else (None, None)


def wrapped(text, width, mark=""):
    words, lines = text.split(), [[]]
    for w in words:
        if sum(map(len, lines[-1])) + len(lines[-1]) + len(w) > width:
            lines.append([])
        lines[-1].append(w)
    return "\n".join(mark + " ".join(x) for x in lines)


def test_license_units(spark):
    """Lines, wrapped headers and whole license files declare their license, against the cosine of each unit with no filter before it."""
    apache, mit = licenses.TEMPLATES["Apache-2.0"][-1], licenses.TEMPLATES["MIT"][-1]
    files = [
        ("This Source Code Form is subject to the terms of the Public v 2.0", "a.c", "MPL-2.0"),
        ("use in source and binary forms, with or without modification, are permitted", "b.c", "BSD-3-Clause"),
        ("Copyright 2020 Someone\n\n" + wrapped(mit, 70), "x/LICENSE", "MIT"),
        ("SPDX-License-Identifier: MIT", "c.c", "MIT"),
        ("# SPDX-License-Identifier: Apache-2.0\nimport os", "d.py", "Apache-2.0"),
        ("// Copyright 2020\n//\n" + wrapped(apache, 40, "// ") + "\nint main() { return frobnicate(quux); }", "e.cc", "Apache-2.0"),
        (wrapped(licenses.TEMPLATES["GPL-3.0"][-1], 60, " * "), "f.c", "GPL-3.0"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nand much more text of other words here " * 3, "y/COPYING", "GPL-3.0"),
        ("SPDX-License-Identifier: Zlib", "g.c", None),
        ("the of and to in that is with", "h.c", None),
        ("the license of this and that software is in the box of warranty, and so on\n" * 40, "i.c", None),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(i, p, t) for i, (t, p, _) in enumerate(files)], "doc_id long, path string, text string")).collect()}
    declared = {i: r["license"] if r["origin"] == "declared" else None for i, r in got.items()}
    assert declared == {i: want for i, (_, _, want) in enumerate(files)}
    rng = random.Random(4)
    pool = [x for texts in licenses.TEMPLATES.values() for x in texts]
    odd = []
    for i in range(300):
        own = rng.choice(pool).split()
        text = " ".join([w for w in own if rng.random() < 0.6] * rng.choice([1, 1, 2]) + [f"x{rng.randrange(99)}" for _ in range(rng.randrange(30))])
        odd.append((wrapped(text, rng.choice([20, 60, 400]), rng.choice(["", "", "# ", "-- "])), rng.choice([None, "p/a.c", "LICENSE-MIT", "sub/COPYING"])))
    odd += [(None, "LICENSE"), ("", "LICENSE"), ("\n\n", "LICENSE"), ("mit license", None)]
    for templates in (licenses.TEMPLATES, {"Own": "use it as you like but keep this notice", "Other": ["ask the owner of the box", "no use without a letter"]}):
        found = licenses.scan(spark.createDataFrame([(i, p, t) for i, (t, p) in enumerate(odd)], "doc_id long, path string, text string"), templates).collect()
        want = {i: best_license(t, p, templates) for i, (t, p) in enumerate(odd)}
        assert {r["doc_id"]: r["license"] if r["origin"] == "declared" else None for r in found} == {i: w[0] for i, w in want.items()}
        assert all(abs(r["score"] - want[r["doc_id"]][1]) < 1e-8 for r in found if r["origin"] == "declared")
    assert licenses.scan(spark.createDataFrame([(0, "a", "use it as you like but keep this notice")], "doc_id long, path string, text string"), {"Own": "use it as you like but keep this notice"}).first()["license"] == "Own"
    tied = {"B": "one two three four", "A": "four three two one"}
    assert licenses.scan(spark.createDataFrame([(0, "a", "one two three four")], "doc_id long, path string, text string"), tied).first()["license"] == "A"


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline

    bench = spark.createDataFrame([(0, " ".join(words(rows[20][1])[2:30]))], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "benchmark", "mixture"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        assert 0 < docs.count() <= before
        if name == "language":
            assert {60, 61, 62, 64}.isdisjoint(r["doc_id"] for r in docs.collect())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(1 <= r["copies"] <= 3 for r in out)
    clash = docs.withColumns({c: F.lit(1) for c in ("copies", "line_dedup", "kept_id", "mixed_id", "label", "hash")})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
        assert stage(spark, clash, str(tmp_path)).count() == stage(spark, docs, str(tmp_path)).count()


def test_scratch_folder(spark):
    from sonolith.llm.common import scratch_dir

    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
