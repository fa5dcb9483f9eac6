"""Personal data, conversation repair and collocations against plain Python on small tables with nulls, ties, repeated and long rows."""

import collections
import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tests.llm.test_odd_input import clashing
from tidewire.llm import collocations as collocations_module
from tidewire.llm import conversation_repair as repair_module
from tidewire.llm.collocations import Automaton, collocations, find
from tidewire.llm.conversation_repair import damaged, repair_conversations, solve, spell
from tidewire.llm.personal_data import Rewritten, all_spans, find_personal_data, identifiers, luhn
from tidewire.llm.queries import op11_personal_data, op12_conversation_repair

# ------------------------------------------------------------------------------------------------ personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_identifiers(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            check = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and check % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_plain_identifiers_against_the_patterns():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "b.c", "@", "@", ".", "-", "+", "_", "1", "22", "255", "4111111111111111", " ", " ", "(", ")", "é", "٣"]) for _ in range(rng.randrange(1, 30)))
        assert [tuple(s) for s in identifiers(text)] == plain_identifiers(text), text
    assert luhn("4111111111111111") and not luhn("4111111111111112")


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("write to john dot smith at example dot com now", "email", "john dot smith at example dot com"),
        ("ask john[at]mail[dot]example[dot]org!", "email", "john[at]mail[dot]example[dot]org"),
        ("ask john (at) example.com.", "email", "john (at) example.com"),
        ("ask john&#64;example&#46;com", "email", "john&#64;example&#46;com"),
        ("ask jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("ask jo​hn@exam­ple.com", "email", "jo​hn@exam­ple.com"),
        ("ask john dot smith@example.com", "email", "john dot smith@example.com"),
        ("host one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
        ("ring plus four nine one five one two three four five six seven eight today", "phone", "plus four nine one five one two three four five six seven eight"),
        ("ring +49 eins fünf eins zwei drei vier fünf", "phone", "+49 eins fünf eins zwei drei vier fünf"),
        ("pay ４１１１ １１１１ １１１１ １１１１ now", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("pay four one one one, one one one one one one one one one one one one", "card", "four one one one, one one one one one one one one one one one one"),
    ],
)
def test_disguises_are_mapped_back(text, kind, want):
    for before in ("", "é ۴ "):
        own = before + text
        assert [(s.kind, own[s.start : s.end]) for s, plain in all_spans(own) if not plain] == [(kind, want)]


@pytest.mark.parametrize("text", ["look at example.com", "one two three and a dot on the map", "un deux trois quatre personnes", "the point at which a line ends. net gain", "1, 2, 3 and four five", "Кириллица без адресов", "prix : 12 345 €"])
def test_clean_texts_stay_clean(text):
    assert all_spans(text) == []


def test_rewriting_keeps_offsets():
    rng = random.Random(2)
    for _ in range(300):
        source = "".join(rng.choice("abcxyz") for _ in range(rng.randrange(0, 20)))
        own = Rewritten(source, re.compile("x+|y|z"), lambda m: {"x": "XX", "y": "", "z": "Z"}[m[0][0]])
        assert own.text == re.sub("z", "Z", re.sub("y", "", re.sub("x+", "XX", source)))
        for i, c in enumerate(own.text):
            start, end, changed = own.back(i, i + 1)
            assert changed == c.isupper()
            assert source[start:end] == c if not changed else source[start] == c.lower()


def test_personal_data_of_odd_and_long_rows(spark):
    long = "a" * 3_000_000 + " x@y.zz " + "1 " * 500_000 + "+1" + " " * 500_000
    rows = [(1, "x@y.zz"), (1, "x@y.zz"), (None, None), (2, ""), (3, "mail a at b dot com"), (4, long), (None, "é +1 (499) 555-6503")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for own in (docs, clashing(docs)):
        got = find_personal_data(own, keep=["doc_id"], masked=True).collect()
        assert len(got) == len(rows)
        told = collections.Counter((r.doc_id, tuple((s.kind, s.start, s.end, s.plain) for s in r.spans)) for r in got)
        assert told == collections.Counter({(1, (("email", 0, 6, True),)): 2, (None, ()): 1, (2, ()): 1, (3, (("email", 5, 19, False),)): 1, (4, (("email", 3_000_001, 3_000_007, True),)): 1, (None, (("phone", 2, 19, True),)): 1})
        assert {r.masked for r in got if r.doc_id in (1, 3)} == {"[EMAIL]", "mail [EMAIL]"}
        assert [r.masked for r in got if not r.spans and r.doc_id is None] == [None]
    assert find_personal_data(docs.limit(0)).count() == 0
    assert find_personal_data(clashing(docs)).columns[-1] == "spans"


def test_personal_data_query_against_the_patterns(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op11_personal_data(spark, sf_dir).collect():
        want = plain_identifiers(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in PLAIN]
        told = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest() and set(told) <= set(r.spans.split(","))


# ------------------------------------------------------------------------------------------------ conversations

MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """rows: initial, must go, truncated. Every way to edit them, by recursion over (row, state, inserts in this gap)."""

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "")] if i == len(rows) and state in (0, 3) else []
        if inserts < 3:
            for role in "ua":
                if (state, role) in MOVES and (rest := best(i, MOVES[state, role], inserts + 1)):
                    found.append((rest[0] + 3, "I" + rest[1]))
        if i < len(rows):
            initial, goes, cut = rows[i]
            if rest := best(i + 1, state, 0):
                found.append((rest[0] + 4, "D" + rest[1]))
            if not goes:
                if (state, initial) in MOVES and (rest := best(i + 1, MOVES[state, initial], 0)):
                    found.append((rest[0] + 3 * cut, "K" + rest[1]))
                for role in "ua":
                    if (state, role) in MOVES and (rest := best(i + 1, MOVES[state, role], 0)):
                        found.append((rest[0] + 3 + 3 * cut, "R" + rest[1]))
        return min(found, default=None)

    return best(0, 0, 0)


def plain_repair(rows):
    """rows (turn, role, text) in order, by plain Python: gaps, blank, duplicate, truncated, illegal, cost, audit, hash."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = cheapest(tuple((r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults)))
    lines, state, left = [], 0, list(rows)
    for letter in audit:
        role = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
        row = left.pop(0) if letter != "I" else None
        if letter == "D":
            continue
        name = row[1] if letter == "K" else role
        lines.append(f"{name}:{row[2] if row else ''}")
        state = MOVES[state, name[:1] if letter == "K" else role[0]]
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def told(text, role):
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()


def random_rows(rng):
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            rows.append((conv, rng.choice([None, *range(6)]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(["A b.", "A b.", "no end", "", " \n", "done! ", None, "x?"])))
    return rows


@pytest.mark.parametrize("run", [1, 2, 1024])
def test_repair_against_all_edits(spark, monkeypatch, run):
    monkeypatch.setattr(repair_module, "RUN", run)
    rng = random.Random(run)
    rows = random_rows(rng)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: tuple(r)[1:-1] for r in repair_conversations(clashing_talk(frame) if run == 2 else frame).collect()}
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    assert got.keys() == by.keys()
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], told(r[2], r[1])))
        assert got[conv] == plain_repair(own), (conv, own)
    assert repair_conversations(frame.limit(0)).count() == 0


def clashing_talk(frame):
    from pyspark.sql import functions as F

    return frame.select("*", *[F.lit("mine").alias(c) for c in ("conv", "told", "copies", "least", "key", "blank", "cut", "audit", "gaps", "_copies", "_conv")])


def test_runs_join_to_the_same_answer():
    rng = random.Random(3)
    for _ in range(300):
        rows = [(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(0, 12))]
        k = rng.randrange(0, len(rows) + 1)
        whole, joined = solve(rows), repair_module.join(solve(rows[:k]), solve(rows[k:]))
        ends = [min((x for x in (t[0][e] for e in (0, 3)) if x is not None), key=lambda x: (x[0], spell(x[1]))) for t in (whole, joined)]
        want = cheapest(tuple(rows))
        assert [(c, spell(w)) for c, w in ends] == [want, want]


def test_a_long_conversation_is_repaired(spark):
    """A conversation of many rows next to short ones: runs of it are made in many tasks."""
    from pyspark.sql import functions as F

    rows = spark.range(30_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("line "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    rows = rows.where("turn <> 7000").union(spark.createDataFrame([(2, 0, "user", "hi.")], "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in repair_conversations(rows).collect()}
    assert (got[1].gaps, got[1].illegal, got[1].cost, len(got[1].audit), got[1].audit.count("I")) == (1, 1, 3, 30_000, 1)
    assert (got[2].cost, got[2].audit) == (3, "KI")


def test_damage_and_repair_of_the_table(spark, sf_dir):
    rows = collections.defaultdict(list)
    everything = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    for r in everything:
        code = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        role, text = r.role or " ", r.text if r.text is not None else " "
        own = rows[r.conv_id]
        if code:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
            own += [(r.turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in op12_conversation_repair(spark, sf_dir).collect()}
    want = {conv: plain_repair(sorted(own, key=lambda r: (r[0] is not None, r[0]))) if own else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, own in rows.items()}
    assert got == want
    assert damaged(spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")).count() == 1


# ------------------------------------------------------------------------------------------------ collocations


def plain_collocations(rows, least, first):
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 6):
                    if i + k <= len(words):
                        f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        found = []
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = {p for b in candidates for i in range(len(b)) for j in range(i + 1, len(b) + 1) for p in [b[i:j]] if p != b and candidates[b] >= candidates.get(p, 1 << 60)}
        for p, a in candidates.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("bits", "shard", "least", "first"), [(22, 1 << 21, 3, 2000), (6, 40, 3, 5), (12, 300, 300, 50)])
def test_collocations_against_plain_counts(spark, monkeypatch, bits, shard, least, first):
    rng = random.Random(bits)
    words = ["a", "b", "b", "the", "THE", "é", "École", "\x80x", "of", "new", "york", "x-1"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "fr", None, ""])) for _ in range(150)]
    rows += [("New York is new york! of the of the", "en")] * 320 + [(None, "en"), ("", "fr"), (" \t\n", "xx"), ("a a a a a a a", "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    monkeypatch.setattr(collocations_module, "SHARD", shard)
    for own in (docs, docs.selectExpr("*", "1 AS doc_id", "2 AS range", "3 AS states", "4 AS part", "5 AS n", "6 AS phrase")):
        got = sorted(tuple(r) for r in collocations(own, least, first, bits).collect())
        assert got == plain_collocations(rows, least, first)
    assert collocations(docs.limit(0)).count() == 0
    assert collocations(docs.where("lang = 'xx'")).count() == 0


def test_collocations_of_a_very_long_text(spark):
    rows = [("never " * 50 + "say never again " * 100_000, "en"), ("x" * 2_000_000, "en")]
    got = {r.phrase: r.a for r in collocations(spark.createDataFrame(rows, "text string, lang string")).collect()}
    assert got["say never again say never"] == 99_999 and len(max(got, key=len)) < 100


def test_automata_share_what_is_equal():
    own = Automaton()
    tail = own.freeze([("york", 7, own.freeze([]))])
    root = own.freeze([("new", 7, tail), ("old", 7, own.freeze([("york", 7, 0)]))])
    assert root == len(own.states) - 1 == 2
    assert [find(own.states, p, {}) for p in (("new", "york"), ("old", "york"), ("old",), ("york",), ())] == [7, 7, 7, 0, 0]
