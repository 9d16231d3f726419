"""Centroids, codes and the language model beside plain Python on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from storyloom.llm import centroids, codes, maxent
from storyloom.llm.plans import QUERIES
from tests.llm.conftest import ordered, prose

SF = "/root/testdata/sf0.01"
FIELDS = "vec_id long, embedding array<double>, label int, x int, cluster string, entry long"


@pytest.fixture(scope="module")
def rows():
    """(vec_id, embedding, label): groups, copies, one vector in a third of the rows, and what must be left out."""
    rng = random.Random(4)
    centre = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    out = [(i, [c + rng.gauss(0, 0.3) for c in centre[i % 12]], i % 5 if i % 7 else None) for i in range(300)]
    out += [(1000 + i, out[17][1], 3) for i in range(150)] + [out[5], (None, out[9][1], None), (None, out[3][1], 1), (7, out[30][1], 2)]
    bad = [None, [], [1.0] * 63, [None] + [0.5] * 63, [float("nan")] * 64, [0.5] * 63 + [float("inf")]]
    return out + [(-i, v, 0) for i, v in enumerate(bad)] + [(2000, [0.0] * 64, 4), (2001, [-0.0] * 64, 4)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "c", 2) for i, v, label in rows], FIELDS)


def usable(rows):
    return [(i, v, label) for i, v, label in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]


def integers(rows, scale):
    return [(i, [math.floor(x * scale) for x in v], label) for i, v, label in usable(rows)]


def closest(x, centres):
    far = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centres]
    return far.index(min(far)), min(far)


def lloyd(vectors, centres, rounds):
    for _ in range(rounds):
        own = [[] for _ in centres]
        for x in vectors:
            own[closest(x, centres)[0]].append(x)
        centres = [[sum(c) // len(m) for c in zip(*m)] if m else old for m, old in zip(own, centres)]
    return centres


def test_centroids(spark, rows):
    kept = integers(rows, 1024)
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centres = lloyd([x for _, x, _ in kept], [x for _, x, _ in sorted(kept, key=key)[:8]], 10)
    found = [(i, *closest(x, centres)) for i, x, _ in kept]
    spent = Counter()
    for _, c, d in found:
        spent[c] += d
    want = [(i, c, d, spent[c], sum(spent.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found]
    assert ordered(centroids.report(table(spark, rows)).collect()) == ordered(want)


def test_centroids_of_few_and_of_no_vectors(spark, rows):
    few = centroids.report(table(spark, rows[:3])).collect()
    assert [r.distance for r in few] == [0, 0, 0] and len({r.cluster for r in few}) == 3
    for none in (table(spark, []), table(spark, rows[-8:-2])):
        assert centroids.report(none).collect() == []
    with pytest.raises(Exception, match="too large"):
        centroids.report(table(spark, [(1, [1e30] * 64, 1)])).collect()


def test_bounds_skip_centres_and_never_the_nearest():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64)) * np.concatenate([[900] * 8, [60] * 56])
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 64)) * 40).astype(np.int64)
    centres = centres.astype(np.int64)
    turn = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :16]
    lead, rest = centroids.split(x, turn)
    best, distance, measured = centroids.nearest(x, lead.astype(np.float32), rest.astype(np.float32), centres, turn)
    whole = ((x[:, None] - centres) ** 2).sum(2)
    assert (best == whole.argmin(1)).all() and (distance == whole.min(1)).all()
    assert measured < 0.2 * whole.size


def coded(rows, entries=16, rounds=6):
    kept = integers(rows, 4096)
    first = [x for _, x, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    books = []
    for p in range(8):
        cut = lambda x: x[8 * p:8 * p + 8]  # noqa: B023, E731
        books.append(lloyd([cut(x) for _, x, _ in kept], [cut(x) for x in first], rounds))
    name = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    found = []
    for i, x, label in kept:
        parts = [closest(x[8 * p:8 * p + 8], books[p]) for p in range(8)]
        found.append((i, "".join(f"{k:02x}" for k, _ in parts), sum(d for _, d in parts), label))
    by = Counter()
    for _, _, error, label in found:
        by[label] += error
    return [(i, code, error, by[label], name) for i, code, error, label in found]


def test_codes(spark, rows):
    assert ordered(codes.report(table(spark, rows)).collect()) == ordered(coded(rows))
    assert ordered(codes.report(table(spark, rows[:5])).collect()) == ordered(coded(rows[:5]))
    for none in (table(spark, []), table(spark, rows[-8:-2])):
        assert codes.report(none).collect() == []


def test_members_move_only_when_their_entry_changes(spark):
    books = np.array([[[0, 0], [100, 100]]])
    part = lambda e, s, p: (0, e, s, p)
    members = spark.createDataFrame([part(0, 3, [1, 2]), part(0, 4, [90, 99]), part(1, 5, [101, 99]), part(1, 6, [50, 50])], codes._MEMBER)
    held = {(r.entry, r.salt, r.moved) for r in codes._hold(members, books).collect()}
    assert held == {(0, 3, False), (1, 4, True), (1, 5, False), (0, 6, True)}
    moved = codes._update(members, np.array([[[0, 0], [100, 100], [7, 7]]]))
    assert moved.tolist() == [[[45, 50], [75, 74], [7, 7]]]


def test_owners_share_a_large_entry(spark):
    """One vector in all rows: its members lie with many owners."""
    copies = spark.createDataFrame([(i, [3] * 64) for i in range(640)], "vec_id long, x array<int>")
    books = np.zeros((8, 1, 8), np.int64)
    owners = codes._enter(copies, books, 32).groupBy("position", "entry", "salt").count().collect()
    assert len(owners) >= 8 * 32 * 0.9 and max(r["count"] for r in owners) <= 32


# ---- language model ----


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def learns(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


def test_base_scores(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    seen = Counter(t for i, text in rows if learns(i) for t in tokens(text))
    n, v = sum(seen.values()), len(seen)
    want = []
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((seen[t] + 1) / (n + v + 1)) for t in own)
        want.append((i, not learns(i), len(own), sum(seen[t] > 0 for t in own), n, round(base, 6)))
    got = maxent.report(docs).collect()
    assert ordered((*r[:5], round(r.base_score, 6)) for r in got) == ordered(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert maxent.report(no_docs).count() == 0
    alone = maxent.report(spark.createDataFrame([(i, "One two") for i in range(40) if not learns(i)], "doc_id long, text string")).collect()
    assert alone and all((r.held_out, r.n_known, r.train_tokens, r.base_score) == (True, 0, 0, 0.0) and math.isfinite(r.score) for r in alone)


def test_scores_by_hand(spark, docs, monkeypatch):
    """With a head of few tokens: most counts reach the documents by the join."""
    monkeypatch.setattr(maxent, "HEAD", 40)
    own = docs.select("doc_id", "text")
    training = own.where("doc_id IS NULL OR crc32(cast(cast(doc_id AS string) AS binary)) % 7 != 2")
    counted = {bytes(r.token): r.n for r in maxent.counts(training).collect()}
    known = maxent.vocabulary(maxent.counts(training))
    model = maxent.train(training, known)
    sizes, place = known.shared_size(), {t: k for k, t in enumerate(known.tokens)}
    for r in maxent.report(docs).collect():
        if r.n_tokens > 3000:
            continue
        texts = [x.text for x in own.collect() if x.doc_id == r.doc_id]
        total, before = 0.0, (maxent.OUTCOMES, maxent.OUTCOMES)
        for t in tokens(texts[0]):
            outcome = place[t] if t in place else maxent.shared_outcome(t)
            total += model.log10(*(np.array([x]) for x in (outcome, before[1], before[0])))[0]
            if t not in place:
                total += math.log10((counted.get(t, 0) + 1) / sizes[zlib.crc32(t) % maxent.SHARED])
            before = (before[1], outcome)
        assert abs(total - r.score) < 1e-3 * (1 + abs(total)), r.doc_id


def test_probabilities_add_up_to_one(spark, docs):
    counted = maxent.counts(docs)
    known = maxent.vocabulary(counted)
    model = maxent.train(docs, known)
    rng = np.random.default_rng(1)
    for _ in range(5):
        one, two = rng.integers(0, maxent.OUTCOMES + 1, 2)
        outcome = np.arange(maxent.OUTCOMES)
        shares = 10 ** model.log10(outcome, np.full(len(outcome), one), np.full(len(outcome), two))
        assert abs(shares.sum() - 1) < 1e-3
    of = Counter()
    for r in counted.collect():
        if bytes(r.token) not in known.tokens[:maxent.OUTCOMES - maxent.SHARED]:
            of[zlib.crc32(bytes(r.token)) % maxent.SHARED] += r.n + 1
    assert [of[k] + 1 for k in range(maxent.SHARED)] == known.shared_size().tolist()


def test_context_is_learned(spark):
    """Alternating words: after either one the other is all but certain, which counts alone cannot know."""
    rng = random.Random(2)
    rows = [(i, " ".join(["ping", "pong"] * 50) + " " + prose(rng, 5)) for i in range(1500)]
    got = maxent.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > 0.5 * sum(r.base_score for r in held)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    held = [r for r in QUERIES["op11_maxent"](spark, SF).collect() if r.held_out]
    assert len(held) > 100 and sum(r.score for r in held) > 0.99 * sum(r.base_score for r in held)


def test_long_texts_are_read_in_stretches(monkeypatch):
    monkeypatch.setattr(maxent, "BLOCK", 7)
    text = b"Ab c\x0bd  efghijklmnopq r\x1cs \xc3\x89 t" * 5
    assert [t for part in maxent.blocks(text) for t in part] == [*text.lower().split(), b""]
    assert list(maxent.blocks(b"")) == [[b""]]
