"""Repair of conversations against an exhaustive search."""

import heapq
import re
import zlib
from collections import defaultdict
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakewarden.llm import conversations, queries

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated"
                   if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, audit and messages by a search over all edits in order of cost, then audit."""
    fault, n = faults(rows), len(rows)
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, k, out = heapq.heappop(heap)
        roles = "".join(r[:1] for r, _ in out)
        if k == n and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, out
        key = (k, roles[-1:] if len(roles) != 1 else roles, len(roles) > 0)
        if key in done:
            continue
        done.add(key)
        options = [(5, "I", 0, (role, "")) for role in ("user", "assistant")]
        if k < n:
            role, text = rows[k]
            options.append((2, "D", 1, None))
            if fault[k] not in ("blank", "duplicate"):
                more = 5 * (fault[k] == "truncated")
                options += [(more, "K", 1, (role, text)), (1 + more, "R", 1, ("user", text)), (1 + more, "R", 1, ("assistant", text))]
        for add, edit, step, message in options:
            grown = out + ((message,) if message else ())
            if re.fullmatch("s?(ua)*u?", "".join(r[:1] or "?" for r, _ in grown)):
                heapq.heappush(heap, (cost + add, audit + edit, k + step, grown))


MESSAGE = st.tuples(st.sampled_from(["system", "user", "assistant", " ", "tool", ""]),
                    st.sampled_from(["Yes.", "No!", "cut", "", " \n", "Why? "]))


def letters(rows):
    at = {"": 0, "truncated": 1, "blank": 2, "duplicate": 3}
    return "".join(conversations.LETTERS[4 * ("sua".find(r[:1]) if r[:1] and r[:1] in "sua" else 3) + at[f]]
                   for (r, _), f in zip(rows, faults(rows)))


@settings(max_examples=500, deadline=None)
@given(st.lists(MESSAGE, max_size=9))
def test_cheapest_and_least_audit(rows):
    assert conversations.repair(letters(rows)) == cheapest(rows)[:2]


def test_long_conversation():
    import random
    draw = random.Random(3)
    text = "".join(draw.choices(conversations.LETTERS, k=20_000))
    cost, audit = conversations.repair(text)
    assert len(audit.replace("I", "")) == len(text)
    price = {"K": 0, "R": 1, "D": 2, "I": 5}
    row_edits = audit.replace("I", "")
    cut = sum(5 for e, c in zip(row_edits, text) if e in "KR" and conversations.LETTERS.index(c) % 4 == 1)
    assert cost == sum(map(price.get, audit)) + cut


def damage(rows):
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain_report(rows):
    groups = defaultdict(list)
    for c, *_ in rows:
        groups[c] = []
    for r in damage(rows):
        groups[r[0]].append(r)
    out = {}
    for c, some in groups.items():
        digest = {r: sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest() for r in some}
        some.sort(key=lambda r: (r[1] is not None, r[1] or 0, digest[r]))
        talk = [(r[2], r[3]) for r in some]
        cost, audit, fixed = cheapest(talk)
        turns = {r[1] for r in some} - {None}
        found = faults(talk)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(found.count, ("blank", "duplicate", "truncated")),
                  illegal, cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_conversation_repair(spark, sf).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == plain_report(rows) and len(got) == len({r[0] for r in rows})
    assert got[0].__fields__ == [*conversations.NAMES, "repaired_sha256"]


def test_rough_conversations(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, "system", "Be."), (1, 2, "assistant", None), (1, 9, None, "Yes."),
            (None, 1, "user", "Hi!"), (None, None, None, None), (2, None, "user", "a"), (3, -5, "tool", ""), (4, 1, "user", "Hi."),
            (4, 3, "user", "Hi."), (4, 2, "assistant", "Hi."), (5, 7, "assistant", "x" * 300_000 + ".")]
    rows += [(6, k, ("user", "assistant", "system")[k * k % 3], f"Word {k * k % 17}.") for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for extra in ("digest", "kind", "initial", "letters", "n", "c", "part", "audit", "a.b", "copy"):
        df = df.selectExpr("*", f"'x' as `{extra}`")
    want = plain_report(rows)
    for parts in ("2", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = conversations.repair_report(conversations.damaged(df), df.select("conv_id")).collect()
        assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    plan = conversations.plans(df)
    edits = conversations.repaired(df, plan).collect()
    assert sum(r["edit"] in "KRD" for r in edits) == len(rows)
    talk = defaultdict(list)
    for r in edits:
        if r["edit"] != "D":
            talk[r["conv_id"]].append((r["position"], r["role"][:1]))
    assert all(re.fullmatch("(s?(ua)+)?", "".join(c for _, c in sorted(x))) for x in talk.values())
    none = df.limit(0)
    assert conversations.repair_report(none, none.select("conv_id")).count() == 0
    assert conversations.repair_report(none, df.select("conv_id")).filter(F.col("audit") == "").count() == 7
