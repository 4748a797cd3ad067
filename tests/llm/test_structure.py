"""Conversation repair, cross-tokenizer alignment and license scans against brute force, on small and awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest

from newsloom.llm import crosstok, licenses, queries, turns
from newsloom.llm.queries import tokenizer

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


def least_audit(block):
    """Every edit of every turn, from the end, by memory of (turn, last role)."""
    after = {"-": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, inserts):
        ways = []
        if i == len(block) and last in "-a":
            ways.append((0, ""))
        if i < len(block):
            initial, fault = block[i]
            cost, audit = best(i + 1, last, 0)
            ways.append((cost + 2, "D" + audit))
            for to in after[last] if fault in (0, 3) else "":
                if to == initial or to != "s":
                    cost, audit = best(i + 1, to, 0)
                    ways.append((cost + (to != initial) + 5 * (fault == 3), ("K" if to == initial else "R") + audit))
        if inserts < 2:
            to = after[last][-1]
            cost, audit = best(i, to, inserts + 1)
            ways.append((cost + 5, "I" + audit))
        return min(ways, default=(1 << 40, ""))

    return best(0, "-", 0)


def told(block):
    made = turns._Conversation(1)
    for i, (initial, fault) in enumerate(reversed(block)):
        made.add(len(block) - i, initial, fault)
    return made.told()


@pytest.mark.parametrize("block", [256, 1, 3])
def test_alignment_in_blocks(monkeypatch, block):
    monkeypatch.setattr(turns, "BLOCK", block)
    rnd = random.Random(block)
    for _ in range(600):
        made = [(rnd.choice("suuaaax"), rnd.choice((0, 0, 0, 0, 1, 2, 3))) for _ in range(rnd.randint(0, 9))]
        assert told(made)[-2:] == least_audit(tuple(made)), made


def test_long_conversation():
    rnd = random.Random(1)
    made = [("ua"[i % 2] if rnd.random() > 0.1 else "u", rnd.choice((0,) * 8 + (1, 3))) for i in range(5000)]
    conv_id, *_, cost, audit = told(made)
    assert len(audit.replace("I", "")) == 5000
    left, paid, at = "", 0, 0
    for edit in audit:
        initial, fault = ("", 0) if edit == "I" else made[at]
        at += edit != "I"
        paid += {"K": 0, "R": 1, "D": 2, "I": 5}[edit] + 5 * (edit in "KR" and fault == 3)
        assert edit == "D" or fault not in (1, 2)
        if edit != "D":
            left += initial if edit == "K" else "a" if left.endswith("u") else "u"
    assert re.fullmatch("(s?(ua)+)?", left) and paid == cost


def test_turn_repair(spark, tmp_path):
    rnd = random.Random(2)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rnd.randint(1, 9)):
            text = rnd.choice(["Hello there.", "Cut here", "", " \t", None, "Why?", "é日😀!", "again.", "again.", "x" * 5000 + "."])
            rows.append((conv, None if rnd.random() < 0.05 else turn, rnd.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]), text, "other"))
    rows += rows[:5]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    want = []
    for conv in {r[0] for r in rows}:
        hurt = []
        for _, turn, role, text, _ in [r for r in rows if r[0] == conv]:
            how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if how:
                text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
                hurt += [(turn, "user" if how == 4 else role, text)] * (1 + (how == 3))
        hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        block, seen = [], set()
        for _, role, text in hurt:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            block.append((role[:1] or " ", 1 if not ink else 2 if (role, text) in seen else 0 if ink[-1] in ".!?" else 3))
            seen.add((role, text))
        cost, audit = least_audit(tuple(block))
        said, at, last = [], 0, "-"
        for edit in audit:
            if edit != "D":
                last = hurt[at][1][0] if edit == "K" else "a" if last == "u" else "u"
                said.append((hurt[at][1] if edit == "K" else {"u": "user", "a": "assistant"}[last]) + ":" + ("" if edit == "I" else hurt[at][2]))
            at += edit != "I"
        numbers = [t for t, _, _ in hurt if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults = Counter(f for _, f in block)
        illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(block, block[1:]))
        want.append((conv, gaps, faults[1], faults[2], faults[3], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    got = [tuple(r) for r in queries.op11_turn_repair(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_repair_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    found = turns.audits(turns.judged(rows))
    assert found.count() == 0
    assert turns.digests(turns.repaired(rows, found)).count() == 0


TEXTS = [None, "", " ", "a", "Hello world", "  two  blanks ", "line\nnext\n\n  far\t\ttab \r\n", "é日 😀 x y　z", "mark ▁ inside", "<|endoftext|> <s> </s>", "don't we'll 12345 !!!??", "naïve" * 300, "\x00\x01 odd", "same same same same", "same same same same", "名前は中村です。" * 40]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(4)
    texts = TEXTS + ["".join(rnd.choice("ab é\n\t日.'1 ") for _ in range(rnd.randint(1, 300))) for _ in range(60)]
    return spark.createDataFrame([(i if i % 13 else None, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, pair string, n_a int").repartition(3)


def test_alignment_of_tokens(docs, monkeypatch):
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    of = {c: b for c, b in crosstok.byte_alphabet().items()}
    spelled = {i: bytes(of[c] for c in t if c in of) for t, i in first.get_vocab().items()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    all_links, out = [], []
    for doc_id, text in rows:
        a, b, ends = [], [], []
        if text:
            a = [(i, spelled[i]) for i in first.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := second.id_to_piece(i)) else p.replace("▁", " ").encode()) for i in second.encode(text)]
        if any(b"".join(x for _, x in side) != (" " + (text or "")).encode() for side in (a, b)):
            a, b = [], []
        spans = []
        for side in (a, b):
            at, held = 0, []
            for i, x in side:
                held.append((at, at + len(x), i))
                at += len(x)
            spans.append(held)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= cut) for side in spans))
            low = cut
        all_links += links
        out.append((doc_id, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    counts, highest = Counter(all_links), defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    want = [(d, na, nb, ng, len(ls), sum(counts[x] == highest[x[1]] for x in ls), sum(counts[x] for x in ls), mark) for d, na, nb, ng, ls, mark in out]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = [tuple(r) for r in crosstok.align(docs, A, B).select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = crosstok.align(docs, A, B, keep=("n_a", "pair")).columns
    assert kept[:2] == ["n_a", "pair"]
    assert crosstok.align(docs.limit(0), A, B).count() == 0


def test_products():
    import numpy as np

    rnd = np.random.default_rng(1)
    for _ in range(50):
        x, y = rnd.random((7, 9)) < 0.3, rnd.random((9, 5)) < 0.3
        made = [crosstok.Incidence(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1]) for m in (x, y)]
        rows, columns, values = made[0].product(made[1])
        dense = np.zeros((7, 5), int)
        dense[rows, columns] = values
        assert (dense == x.astype(int) @ y.astype(int)).all() and len(rows) == (dense > 0).sum()
        back = made[0].transposed(9)
        assert (np.diff(back.starts) == x.sum(0)).all()


def accepted(words, markup):
    """All ends of a template from the start of ``words``, by trying every way."""
    parts = [m for m in re.finditer(r"\[\[|\]\]|\{\{\s*(\d+)\s*-\s*(\d+)\s*\}\}|\{\{([^{}]*)\}\}|[^\[\]{}]+", markup)]

    def go(k, at):
        if k == len(parts):
            return {at}
        part = parts[k]
        if part[0] == "[[":
            depth, to = 1, k
            while depth:
                to += 1
                depth += {"[[": 1, "]]": -1}.get(parts[to][0], 0)
            return go(k + 1, at) | go(to + 1, at)
        if part[0] == "]]":
            return go(k + 1, at)
        if part[1] is not None:
            return set().union(*[go(k + 1, at + n) for n in range(int(part[1]), int(part[2]) + 1) if at + n <= len(words)])
        out = set()
        for way in part[3].split("|") if part[3] is not None else [part[0]]:
            spelled = licenses.words_of(way)
            if words[at : at + len(spelled)] == spelled:
                out |= go(k + 1, at + len(spelled))
        return out

    return go(0, 0)


def test_licenses(spark):
    rnd = random.Random(6)
    templates = {"one": ("a [[b [[c]] ]] {{0-2}} d", "b {{a b|c}} [[d]] e"), "two": ("{{a|b}} c {{1-3}} a",)}
    texts = [None, "", "...", "A-b C.d", "mit  LICENSE, mit license mit", "MIT licenseé"] + [" ".join(rnd.choices("a b c d e f".split(), k=rnd.randint(1, 60))) for _ in range(150)]
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, matches int").repartition(3)
    got = {r.row.doc_id: (r.n_words, [tuple(m) for m in r["matches"]]) for r in licenses.find_licenses(table, templates, {"mit license": "mit", "a a": "twice"}).collect()}
    for i, text in enumerate(texts):
        words = licenses.words_of(text or "")
        want = [("mit", at, at + 2, True) for at in range(len(words)) if words[at : at + 2] == ["mit", "license"]]
        want += [("twice", at, at + 2, True) for at in range(len(words)) if words[at : at + 2] == ["a", "a"]]
        for label, several in templates.items():
            free = 0
            for at in range(len(words)):
                ends = set().union(*[accepted(words[at:], x) for x in several])
                if ends and at >= free:
                    free = at + max(ends)
                    want.append((label, at, free, False))
        assert got[i] == (len(words), sorted(want, key=lambda x: (x[1], x[0], x[2]))), text


def test_license_wording(spark):
    def filled(markup):
        return re.sub(r"\{\{\s*(\d+)\s*-\s*\d+\s*\}\}", lambda m: " x" * int(m[1]) + " ", re.sub(r"\{\{([^{}]*\|[^{}]*)\}\}", lambda m: m[1].split("|")[0], markup)).replace("[[", "").replace("]]", "")

    cases = [(k, filled(x)) for k, several in licenses.TEMPLATES.items() for x in several]
    found = licenses.find_licenses(spark.createDataFrame([(k, "Before; " + t + " after.") for k, t in cases], "doc_id string, text string"))
    for row in found.collect():
        assert row.row.doc_id in {m.label for m in row["matches"] if not m.base}
    broken = licenses.find_licenses(spark.createDataFrame([(k, re.sub("[Cc]opies|LIABLE|under|redistribute|reserved|DISCLAIMED", "other", t)) for k, t in cases], "doc_id string, text string"))
    assert all(row.row.doc_id not in {m.label for m in row["matches"]} for row in broken.collect())
    assert licenses.find_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("bad", ["a [[b", "a ]] b", "{{2-1}} a", "a {{3-1}}", "{{0-2}} a", "[[a]]", "a {b"])
def test_bad_markup(bad):
    with pytest.raises(ValueError):
        licenses.Automaton({"x": (bad,)})


def test_sketches_rule_out_no_near_pair(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from newsloom.llm import simhash

    rnd = np.random.default_rng(3)
    rows, near = [], []
    for n in (0, 1, 3, 40, 300, 5000):
        for _ in range(30):
            a = rnd.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.concatenate([a[: int(n * rnd.uniform(0.5, 1))], rnd.integers(0, 1 << 63, int(n * rnd.uniform(0, 0.6))).astype(np.uint64)])
            near.append(len(a) > 0 and len(b) > 0 and len(np.intersect1d(a, b)) >= simhash.STAGE_COSINE * np.sqrt(len(a) * len(b)))
            rows.append((len(rows), simhash.sketched(np.unique(a)), simhash.sketched(np.unique(b))))
    kind = "struct<size:int,sketch:array<bigint>>"
    table = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}").select("i", simhash.may_be_near(F.col("a"), F.col("b")).alias("able"))
    able = {r.i: r.able for r in table.collect()}
    assert any(near) and all(able[i] for i, x in enumerate(near) if x)
    assert not all(able.values())


def test_spanning_keeps_components(spark):
    from newsloom.llm import simhash
    from newsloom.llm.graph import components

    rnd = random.Random(1)
    links = spark.createDataFrame([(a, b) for a, b in ((rnd.randint(0, 300), rnd.randint(0, 40)) for _ in range(260)) if a != b], "a long, b long").distinct()
    groups = lambda x: sorted(tuple(r) for r in components(x, "a", "b").collect())
    assert groups(simhash.spanning(links)) == groups(links)


def test_near_dedup_searches_fingerprints_by_the_pigeonhole_plan(spark, monkeypatch):
    from newsloom.llm import simhash
    from newsloom.llm.graph import components

    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(30)]
    marks = [m ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for m in base for _ in range(8)]
    keys = [i.to_bytes(16, "big") for i in range(len(marks))]
    nodes = spark.createDataFrame([(k, simhash.signed(m)) for k, m in zip(keys, marks)], "key binary, fp long")
    pairs = simhash.bit_pairs(nodes)
    near = lambda i, j: (marks[i] ^ marks[j]).bit_count() <= simhash.STAGE_RADIUS
    assert all(near(keys.index(r.a), keys.index(r.b)) for r in pairs.collect())
    root = {k: k for k in keys} | {bytes(r.node): bytes(r.root) for r in components(pairs, "a", "b").collect()}
    assert any(near(i, j) for i in range(len(marks)) for j in range(i))
    assert all(root[keys[i]] == root[keys[j]] for i in range(len(marks)) for j in range(i) if near(i, j))

    texts = [" ".join(f"w{rnd.randrange(9999)}" for _ in range(90)) for _ in range(5)]
    met, search = [], simhash.bit_pairs
    monkeypatch.setattr(simhash, "bit_pairs", lambda n: met.append([r.fp for r in n.select("fp").collect()]) or search(n))
    simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [sorted(x) for x in met] == [sorted(simhash.signed(simhash.fingerprint(t, simhash.STAGE_SHINGLE, distinct=True)) for t in texts)]


def test_a_large_group_of_near_copies_meets_few_pairs(spark, monkeypatch):
    from newsloom.llm import simhash

    rnd = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(250):  # two of them have a cosine of 0.65 or so, so many pairs that meet are no near copies
        copy = list(words)
        for at in rnd.sample(range(200), rnd.randint(3, 10)):
            copy[at] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(copy))
    met, judged = [], simhash.near_enough
    monkeypatch.setattr(simhash, "near_enough", lambda pairs, nodes: met.append(pairs.count()) or judged(pairs, nodes))
    got = [r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    sets = [set(simhash.shingle_set(t)[1].tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= simhash.STAGE_COSINE * (len(sets[i]) * len(sets[j])) ** 0.5:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert sorted(got) == sorted({*root})
    assert sum(met) < 50 * len(texts)


def test_components_in_few_tasks_and_folders(spark):
    from newsloom.llm.common import noted
    from newsloom.llm.graph import components

    rnd = random.Random(7)
    rows = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(300)] + [(None, 1), (2, 2), (900, 901), (901, 902), (902, 903)] + [(1000, i) for i in range(1001, 1100)]
    root = {}
    for a, b in rows:
        if a is not None and a != b:
            a, b = (root.setdefault(x, x) for x in (a, b))
            root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    links = spark.createDataFrame(rows, "a long, b long").repartition(1)
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    context.setJobGroup("components", "")
    with noted() as made:
        found = components(links, "a", "b")
    tasks, rounds = 0, sum("components-large" in path for path in made)
    for job in tracker.getJobIdsForGroup("components"):
        stages = [tracker.getStageInfo(k) for k in tracker.getJobInfo(job).stageIds]
        tasks += sum(s.numCompletedTasks for s in stages if s)
    context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, found.collect())) == sorted(root.items())
    assert tasks < 40 * (rounds or 1)
    folder = context._jvm.org.apache.hadoop.fs.Path
    left = [p for p in made if folder(p).getFileSystem(context._jsc.hadoopConfiguration()).exists(folder(p))]
    assert left == made[-1:]


def test_near_dedup_leaves_two_folders(spark):
    from newsloom.llm.common import MADE
    from newsloom.llm.simhash import drop_near_copies

    rnd, before = random.Random(8), set(MADE)
    base = [[f"w{rnd.randrange(9999)}" for _ in range(120)] for _ in range(6)]
    texts = [" ".join([*b[:at], "other", *b[at + 1 :]]) for b in base for at in (3, 60, 118)]
    kept = drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 6, 9, 12, 15]
    assert len([p for p in MADE if p not in before]) == 2  # the nodes and their groups


def test_the_search_sends_no_side_that_grows_through_the_driver(spark):
    from pyspark.sql import functions as F

    from newsloom.llm import simhash
    from newsloom.llm.common import stored

    rows = spark.range(3000).select(F.xxhash64(F.col("id") % 1500).bitwiseXOR(F.when(F.col("id") < 1500, 0).otherwise(5).cast("long")).alias("fp"))
    first, known, second = simhash.search(stored(rows.distinct(), "search-nodes"), {"fp": 3})
    for df in (first, second):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert first.count() and known.select("root").distinct().count() == 1500
