"""Sanitisation, periodic runs and the prefix trie against brute force, and on odd rows: nulls, empty and long texts, ties, repeated rows, empty
tables, extra columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import periodic_runs, prefix_trie, sanitise
from tallyspark.llm import queries as llm

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def counts(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return all(int(x) <= 255 for x in hit.split(".")) if kind == "ip" else 10 <= len(d) <= 15 if kind == "phone" else True


def private(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if counts(kind, m[0]))


ODD = [None, "", " ", "a@b.cd%x@y.zz", "x@y.z@w.q.r a.b@c", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255", "+1 (555) 010-2030x +12", "4111 1111 1111 1111, 4111-1111-1111-1112",
       "é" * 5 + "x.y@mail.example.com 语+49 170 1234567", "a" * 30_000, "1" * 30_000, "a@b" + ".c" * 20_000, "+1" + "(" * 20_000, "4111111111111111 " * 400]


def test_op11_base(spark):
    r = random.Random(5)
    texts = ODD + ["".join(r.choice("a1@.+- (9") for _ in range(r.randint(1, 80))) for _ in range(500)]
    docs = spark.createDataFrame([(i, t, 1, "x", [1]) for i, t in enumerate(texts)], "doc_id long, text string, start int, kind string, base array<int>")
    got = {x.doc_id: [(s.start, s.kind, s.end) for s in x.base] for x in sanitise.found(docs)[0].collect()}
    assert got == {i: private(t) for i, t in enumerate(texts)}


def marked(texts, hidden=1.0, support=3):
    """The disclosing terms of some texts, with their actions, by plain counting."""
    strip = lambda w: w.lower().strip(sanitise.PUNCTUATION)
    term = lambda t: len(t) >= 2 and "@" not in t and re.search(r"[^\W\d_]", t)
    words = [w for t in texts for w in re.split(sanitise.GAP, t or "") if w]
    near = defaultdict(lambda: defaultdict(list))
    for t in texts:
        for a, k, b in private(t):
            low = max(a - 160, 0)
            left, right = t[low:a], t[b : b + 160]
            left = re.sub(rf"^{sanitise.WORD}", "", left) if low else left
            right = re.sub(rf"{sanitise.WORD}$", "", right) if len(right) == 160 else right
            both = [strip(w) for w in re.split(sanitise.GAP, re.sub(rf"{sanitise.WORD}$", "", left) + " " + re.sub(rf"^{sanitise.WORD}", "", right))]
            near[f"{sanitise.KINDS[k]}:{t[a:b].lower()}"][t].append([w for w in both if term(w)])
    n_t = defaultdict(int)
    for w in words:
        n_t[strip(w)] += 1
    stems = defaultdict(int)
    for w, n in n_t.items():
        if term(w):
            stems[w[:3]] += n
    out = defaultdict(set)
    for of in near.values():
        n_te, n_se, where, n_e = defaultdict(int), defaultdict(int), defaultdict(set), 0
        for t, lists in of.items():
            for x in lists * texts.count(t):
                n_e += len(x)
                for w in x:
                    n_te[w], n_se[w[:3]] = n_te[w] + 1, n_se[w[:3]] + 1
            for x in lists:
                for w in x:
                    where[w].add(tuple(lists[0]))
        for w, n in n_te.items():
            if len(where[w]) >= support and n_e * 2**hidden < len(words) and n_t[w] <= min(n, n_t[w]) * 2**hidden:
                out[w].add("remove" if len(w) <= 3 or stems[w[:3]] <= min(n_se[w[:3]], stems[w[:3]]) * 2**hidden else "generalise")
    return {w: max(a) for w, a in out.items()}


def test_op11_terms(spark):
    r = random.Random(2)
    filler = ["".join(r.choice("abdelmnorst") for _ in range(r.randint(2, 7))) for _ in range(150)]
    text = lambda n: " ".join(r.choice(filler) for _ in range(n))
    texts = [text(60) for _ in range(40)]
    texts += [f"{text(3)} Zorblat, quibble{'' if i else 's'} at boss@corp.example.org {text(4)}; (zorblat) {text(40)}" for i in range(6)]
    texts += [f"{text(30)} zormund zorbach zorenth {text(20)}" for _ in range(5)] + ["same twice kelvort 10.20.30.40 word"] * 9 + [None, ""]
    want = marked(texts)
    assert want["zorblat"] == "generalise" and want["quibble"] == "remove" and "kelvort" not in want
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    spans, terms = sanitise.found(docs)
    assert {x.term: x.action for x in terms.collect()} == want
    for x in spans.collect():
        t = texts[x.doc_id] or ""
        assert [(s.start, s.end) for s in x.terms] == [m.span() for m in re.finditer(r"[A-Za-z]+", t) if m[0].lower() in want and not any(
            a < m.end() and m.start() < b for a, _, b in private(t))]
    duck = pytest.importorskip("duckdb").connect()
    duck.register("documents", docs.toPandas())
    told = dict(duck.execute(f"SELECT doc_id, spans FROM ({sanitise.OP11_SQL})").fetchall())
    listed = lambda x: ",".join(f"{sanitise.KINDS[s.kind]}:{s.start}:{s.end}" for s in sorted([*x.base, *x.terms], key=lambda s: (s.start, s.kind)))
    assert {x.doc_id: listed(x) for x in spans.collect()} == told and sum("term" in v for v in told.values()) == 6
    clean = {x.doc_id: x.text for x in sanitise.sanitised(docs).collect()}
    assert len(clean) == len(texts) and clean[45].count("zor*") == 2 and "[EMAIL]" in clean[45] and "quibble" not in clean[45] and clean[len(texts) - 2] is None
    assert all(clean[i] == t for i, t in enumerate(texts) if t and not private(t) and not set(re.findall("[a-z]+", t)) & set(want))


def test_op11_empty(spark):
    assert sanitise.found(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0
    rows = spark.createDataFrame([(None, "a@b.cd"), (None, "a@b.cd"), (3, None)], "doc_id long, text string")
    assert sorted(len(x.base) for x in sanitise.found(rows)[0].collect()) == [0, 1, 1]


def plain_runs(w):
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    own = plain_runs(w)
    best = None
    for x in own:
        if best is None or x[1] * best[2] > best[1] * x[2]:
            best = x
    gone = {i for a, n, q in own for i in range(a + q, a + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(own), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in own)),
            sha(" ".join(v for i, v in enumerate(w) if i not in gone)))


def test_op12(spark):
    r = random.Random(1)
    rows = [(None, "x " * 9), (1, None), (2, ""), (3, " \n\t "), (4, "é é é é é é"), (4, "é é é é é é"), (5, "la " * 3000), (6, "w w " * 7 + "end"), (7, "a b " * 3 + "a")]
    for i in range(400):
        k = r.choice([1, 2, 3, 40])
        w = [f"w{r.randrange(k)}" for _ in range(r.choice([1, 5, 6, 12, 40, 90]))]
        at = r.randrange(len(w))
        rows.append((100 + i, " ".join(w[:at] + w[at : at + r.randint(1, 6)] * r.randint(1, 7) + w[at:])))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    got = sorted(map(tuple, periodic_runs.periodic_runs(docs, periodic_runs.planted).collect()), key=repr)
    assert got == sorted((plain_row(i, t) for i, t in rows), key=repr)
    assert sum(x[1] > 0 for x in got) > 100
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_op12_batches(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BATCH", 1)
    rows = [(i, "a b c " * (i % 9) + "end") for i in range(30)]
    texts = [(i, t.encode().split()) for i, t in rows]
    assert periodic_runs.runs_of_batch(texts, 6, 4) == [x for t in texts for x in periodic_runs.runs_of_batch([t], 6, 4)]


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    convs = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        new = tuple(convs.get(c - abs(c) % 100 * (1 if c > 0 else -1), [])[:h] + own[h:])
        for d in range(len(new) + 1):
            members[new[:d]].append(c)
        ends[new].append(c)
    out = {}
    for node, m in members.items():
        kids = [x for x in members if len(x) == len(node) + 1 and x[: len(node)] == node]
        below = [x for x in members if x[: len(node)] == node]
        parents = {x[:-1] for x in members if x}
        out[min(m), len(node)] = (min(members[node[:-1]]) if node else None, len(m), len(kids), sum(x not in parents for x in below),
                                  sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
                                  hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_op13(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "IDS", 1 if block == 3 else 1024)
    r, rows = random.Random(3), []
    for c in [*range(0, 40), 100, 101, 102, 103, 104, 105, 305, 306, 2050, -7, 10**12 + 3]:
        rows += [(c, t, r.choice(["user", "assistant", None]), r.choice(["hi", "", None, "é語", "go on"])) for t in range(r.randint(1, 9))]
    rows += [(7, None, "system", "first"), (7, None, None, "tie"), (8, 0, "user", "hi"), (8, 0, "user", "hi"), (None, 1, "user", "no id"), (11, 50, "user", "x" * 20_000)]
    rows += [(500, t, "user", str(t)) for t in range(90)]
    table = spark.createDataFrame([(*x, 1, "n") for x in rows], "conv_id long, turn int, role string, text string, depth int, n_convs string")
    got = {(x.conv_id, x.depth): tuple(x[c] for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
           for x in prefix_trie.prefix_trie(table.repartition(3)).collect()}
    assert got == plain_trie(rows)
    assert prefix_trie.prefix_trie(table.limit(0)).count() == 0


def test_native_plan(spark):
    docs = spark.createDataFrame([(1, "a@b.cd x")], "doc_id long, text string")
    for df in (docs.select(sanitise.base_spans(F.col("text"))), docs.select(sanitise.contexts(F.col("text"), sanitise.base_spans(F.col("text"))))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_registered():
    assert {"op11_private", "op12_runs", "op13_trie"} <= set(llm.queries())
