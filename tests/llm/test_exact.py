"""Operators beside brute force on a small table."""

import base64
import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np

from storyloom.llm import jaccard, lines, secrets, suffixes, warc
from storyloom.session import checkpoint_folder
from tests.llm.conftest import ordered, prose


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_suffix_removal(docs, no_docs):
    seen, rows = Counter(), pairs(docs)
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        seen.update(b[i:i + 200] for i in range(len(b) - 199))
    want = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\x01" * 200
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        want.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert ordered(suffixes.report(docs).collect()) == ordered(want)
    assert suffixes.report(no_docs).count() == 0


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def test_jaccard_groups(docs, no_docs):
    rows = [(d, shingle_set(t, 4)) for d, t in pairs(docs)]
    up = {k: k for k in range(len(rows))}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                up[root(i)] = root(j)
    smallest = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        if d is not None:
            smallest[root(k)].append(d)
    want = [(d, len(s), min(smallest[root(k)], default=None)) for k, (d, s) in enumerate(rows)]
    assert ordered(jaccard.grouped(docs, 4, 85).collect()) == ordered(want)
    assert jaccard.grouped(no_docs, 4, 85).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {0, 1, 100, 101, 102, None} <= ids and not {2, 8, 104, 108} & ids


def test_of_one_id_only_the_similar_text_goes(spark):
    alone, twin = "this text stands alone and nothing is like it", "that other text has a twin of a smaller number"
    rows = spark.createDataFrame([(2, twin), (5, alone), (5, twin), (7, twin)], "doc_id long, text string")
    assert ordered(jaccard.keep_one(rows).collect()) == [(2, twin), (5, alone)]
    # The id's other text is a smaller set of a group whose least id is another's.
    long = " ".join(f"word{k}" for k in range(60))
    near = long + " more"
    rows = spark.createDataFrame([(3, near), (5, long), (5, alone)], "doc_id long, text string")
    assert ordered(jaccard.keep_one(rows).collect()) == [(3, near), (5, alone)]
    assert ordered((r.doc_id, r.component_id) for r in jaccard.grouped(rows).collect()) == [(3, 3), (5, 3), (5, 5)]


def test_kept_columns_may_have_any_name(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", 7, 8, 9), (2, "a b c d e f", 1, 2, 3)], "doc_id long, text string, _text int, _id int, _key int")
    assert ordered(jaccard.keep_one(rows).collect()) == [(1, "a b c d e f", 7, 8, 9)]


def test_line_removal(docs, no_docs):
    seen, want = [], set()
    for d, t in sorted({p for p in pairs(docs) if p[1] is not None}, key=lambda p: (p[0] is not None, p[0])):
        for n, line in enumerate(t.split("\n")):
            words = line.lower().split()
            if words:
                own = frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4)))
                if any(len(own & s) >= 0.8 * len(own | s) - 1e-9 for s in seen):
                    want.add((d, n))
                seen.append(own)
    assert ordered(lines.report(docs).collect()) == ordered(want)
    assert lines.report(no_docs).count() == 0
    kept = lines.dedup(docs)
    assert kept.columns == docs.columns
    by_id = {r.doc_id: r for r in kept.collect()}
    assert by_id[100].text is None and by_id[101].text == "" and 104 not in by_id
    assert all(r.n_chars == len(r.text) for r in by_id.values() if r.text is not None)


def test_long_lines_are_told_apart_by_marks(spark, monkeypatch):
    """Long lines that share a passage only are not compared as whole sets; what reads nothing any more is deleted."""
    rng = random.Random(5)
    passage = prose(rng, 30)
    texts = [f"{prose(rng, 200)} {passage}" for _ in range(40)]
    # Near copies: one word changed, and lengths on both sides of the one that marks go by.
    for k in (3, 17):
        words = texts[k].split(" ")
        words[90] = "changed"
        texts.append(" ".join(words))
    whole = prose(rng, lines.SHORT + 9)
    texts += [whole, whole.rsplit(" ", 7)[0]]
    met, verified = [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, *more: met.append(pairs.count()) or verified(pairs, *more))
    folder = checkpoint_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert ordered(lines.report(rows).collect()) == [(40, 0), (41, 0), (43, 0)]
    assert sum(met) < 20
    assert {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before if name.startswith("line-")} == {"line-gone"}


def found(text):
    """Base spans, by the standard library."""
    text, out = text or "", []
    key = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] if len(m[2]) >= 8 else []
    for k, pattern, least in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        out += [(m.start(), k, f"{('access', 'hex')[k - 1]}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [s for *_, s in sorted(out)]


def test_secrets(spark, docs, no_docs):
    odd = [
        'é Token = "abcdefgh1" x', "token=secret: abcdefgh", "token=secret=abcdefghij", "AKIAABCDEFGH1234 AKIA12", "0123456789abcdef" * 2 + "g" + "0123456789abcdef" * 3,
        "api_key:'0123456789abcdef0123456789abcdef'", "API-KEY=abcdefgh", "password " + "a" * 40, "ghp_" + "a" * 36, "😀 passwd='12345678' secret:short", "",
    ]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(more)
    got = secrets.report(rows).collect()
    want = [(d, hashlib.sha256(",".join(found(t)).encode()).hexdigest()) for d, t in pairs(rows)]
    assert ordered((r.doc_id, r.base_sha256) for r in got) == ordered(want)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1005].n_assign == 1 and by_id[1005].n_hex == 1 and "github:" in by_id[1008].spans
    assert secrets.report(no_docs).count() == 0


def match_of(rng, nodes):
    """A random text that the parsed expression matches."""
    out = ""
    for kind, at in nodes:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(at)
        elif kind == "IN":
            member, value = rng.choice(at)
            out += chr(value if str(member) == "LITERAL" else rng.randint(*value))
        elif kind == "SUBPATTERN":
            own = match_of(rng, at[-1])
            out += "".join(rng.choice((c, c.upper())) for c in own) if at[1] & re.IGNORECASE else own
        elif kind == "BRANCH":
            out += match_of(rng, rng.choice(at[1]))
        elif kind == "MAX_REPEAT":
            low, high, inner = at
            out += "".join(match_of(rng, inner) for _ in range(rng.randint(low, min(int(high), low + 20))))
        else:
            raise AssertionError(kind)
    return out


def test_literals_occur_in_every_match():
    rng = random.Random(2)
    for rule in secrets.RULES:
        for _ in range(500):
            text = match_of(rng, re._parser.parse(rule.pattern))
            assert re.fullmatch(rule.pattern, text)
            assert not rule.literals or any(all(word in text.lower() for word in words) for words in rule.literals), (rule.kind, text)


def test_warc_round_trip(spark):
    rows = [(1, "http://a.b/x", "<p>é"), (2, None, None), (3, "bad url", ""), (None, "http://a.b/x", "<p>é"), (1, "http://a.b/x", "<p>é"), (7, "http://a.b/x", "<p>é"), (8, "http://a.b/y", "x" * 300_000)]
    rows += [(100 + i, "http://h.co/z", f"p{i}") for i in range(1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in rows:
        data, head = (html or "").encode(), first.get(html or "")
        again = i is not None and head < i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", head if again else None))
    assert ordered(warc.round_trip(spark, pages).collect()) == ordered(want)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0
    folder, captures = warc.write(pages)
    root = warc.build_index(folder, captures)
    asked = spark.createDataFrame([("b,a)/x",), ("no,such)/",), ("co,h)/z",)], "url_key string")
    hits = warc.lookup(asked, folder, root)
    assert hits.count() == 3 + 1 + 1200
    payloads = {bytes(r.payload) for r in warc.read(hits.where("url_key = 'b,a)/x'"), folder).collect() if r.payload is not None}
    assert payloads == {"<p>é".encode()}


def test_long_sets_are_told_apart_unread(spark):
    """Marks of fixed size are full for long sets and let every pair pass."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    half, near = base[:900] + [f"v{rng.randrange(10**6)}" for _ in range(600)], base[:1490] + ["x"] * 10
    rows = spark.createDataFrame([(k, " ".join(words)) for k, words in enumerate((base, half, near, base[:12], base[:11]))], "doc_id long, text string")
    levels = spark.sparkContext.broadcast(bytes(1 << jaccard.BUCKET_BITS))
    found = jaccard.described(rows, levels, 4, 85).cache()
    nodes = found.withColumnRenamed("set_key", "node")
    node = {r.doc_id: r.node for r in nodes.collect()}
    pairs = spark.createDataFrame([(node[0], node[1]), (node[0], node[2]), (node[3], node[4])], "a long, b long")
    got = {(r.a, r.b) for r in jaccard._differ_little(pairs, nodes, 85).collect()}
    assert got == {(node[0], node[2]), (node[3], node[4])}


def test_sketches_never_say_too_much():
    rng = np.random.default_rng(4)
    for n in (60, 130, 300, 1000, 5000):
        one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for kept in (n, n - 1, n * 9 // 10, n // 2):
            for more in (0, 1, n // 9, n):
                other = np.unique(np.concatenate([one[:kept], rng.integers(0, 1 << 63, more, dtype=np.uint64)]))
                apart = jaccard._apart(jaccard._sketch(one), jaccard._sketch(other))
                assert apart <= len(np.setxor1d(one, other))
    assert jaccard._apart(b"", jaccard._sketch(one)) == 0


def test_suffix_tables_go_when_read(spark, docs):
    folder = checkpoint_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    suffixes.report(docs).collect()
    assert {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before if name.startswith("suffix-")} == {"suffix-runs"}


def test_jaccard_moves_few_rows_at_a_time(spark, docs, monkeypatch):
    name, seen, levels = "spark.sql.execution.arrow.maxRecordsPerBatch", [], jaccard.rarity_levels
    monkeypatch.setattr(jaccard, "rarity_levels", lambda *given: (seen.append(int(spark.conf.get(name, "10000"))), levels(*given))[1])
    before = spark.conf.get(name, None)
    jaccard.grouped(docs)
    assert seen and max(seen) <= 1000 and spark.conf.get(name, None) == before
