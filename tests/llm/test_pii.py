"""Personal data: fixed patterns against plain code, disguises by round trips."""

import re
from collections import Counter
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewarden.llm import pii, queries


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(sum(map(int, str(int(d) * (1 + k % 2)))) for k, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
             "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
             "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    found = [(m.start(), n, m.end()) for n, (kind, rule) in enumerate(rules.items())
             for m in re.finditer(rule, text) if passes(kind, m[0])]
    return sorted(found)


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(alphabet="a1.@- +", max_size=60), st.text(alphabet="0123456789 -.+()", max_size=80),
                 st.lists(st.sampled_from(["a.b@c.de", "4111 1111 1111 1111", "+49 151 2345678", "1.2.3.4", "x", " ", "@",
                                           ".", "300.1.1.1", "-", "+1", "é"]), max_size=8).map("".join)))
def test_fixed_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1.2." * 100_000, "1-" * 200_000, "+1" * 100_000, "a@" * 100_000,
                 "0O" * 100_000, "one " * 50_000, "( " * 100_000, " at x" * 50_000):
        base = pii.base_spans(text)
        pii.added_spans(text, base, pii.Alike())


DISGUISED = [
    ("email", "john (at) example (dot) com"), ("email", "john.doe at example.com"), ("email", "john at example dot org"),
    ("email", "jоhn@exаmple.com"), ("email", "john＠example．com"), ("email", "jo​hn@exam​ple.com"),
    ("email", "john @ example.com"), ("email", "anna [at] firma [punkt] de"), ("email", "john{at}example{dot}com"),
    ("email", "jean_arobase".replace("_arobase", " (arobase) site (point) fr")), ("email", "JOHN AT EXAMPLE DOT COM"),
    ("phone", "plus four nine one seven oh double five one two three four five"), ("phone", "+４９ １５１ ２３４５６７８９"),
    ("phone", "five five five one two three four five six seven"), ("phone", "+49 l51 2345O78"),
    ("phone", "neun acht sieben sechs fünf vier drei zwei eins null"), ("card", "4111 1111 1111 111l"),
    ("card", "four one one one one one one one one one one one one one one one"), ("card", "4111–1111–1111–1111"),
    ("ip", "192[.]168[.]1[.]10"), ("ip", "10 dot 0 dot 0 dot 1"), ("ip", "one nine two dot one six eight dot one dot one"),
    ("ip", "١٩٢.١٦٨.٠.١"),
]


@pytest.mark.parametrize("kind, disguised", DISGUISED)
def test_disguises_map_back_to_the_source(kind, disguised):
    for before, after in (("", ""), ("Schöne ", ", ok."), ("\U0001F600 ​ text: ", " and more")):
        text = before + disguised + after
        base = pii.base_spans(text)
        found = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.added_spans(text, base, pii.Alike())]
        assert (kind, disguised) in found


@pytest.mark.parametrize("text", [
    "Looking at this dot in the picture.", "We met at noon. At home (at last) it rained.", "Look at example.com for more.",
    "One two three go!", "un deux trois quatre", "He ran 10 km at 5.30 pm", "+1 (848) 555-1373 Un an", "l0l O0 l1l",
    "version 1.2.3", "Привет, мир. α β γ", "at dot at dot", "", "@ . @", "a (.) b [at] c"])
def test_clean_texts_stay_clean(text):
    assert pii.added_spans(text, pii.base_spans(text), pii.Alike()) == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 .,(é​", max_size=20), st.text(alphabet="abc", min_size=1, max_size=6),
       st.sampled_from([" (at) ", "[at]", " {AT} ", "＠", " [@] "]), st.sampled_from([" (dot) ", "[.]", "．", " [DOT] "]))
def test_spans_are_exact(noise, name, at, dot):
    disguised = f"x{name}{at}host{dot}net"
    text = f"{noise} {disguised} {noise}"
    start = len(noise) + 1
    assert (start, pii.EMAIL, start + len(disguised)) in pii.added_spans(text, pii.base_spans(text), pii.Alike())


def test_query_and_rough_rows(spark, rough):
    for docs, got in ((spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), queries.op12_pii(
            spark, "/root/testdata/sf0.01")), (rough, pii.scan(rough))):
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            spans = plain(r["text"] or "")
            joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
            want[r["doc_id"], *(sum(k == n for _, k, _ in spans) for n in range(4)), sha256(joined.encode()).hexdigest()] += 1
        rows = got.collect()
        assert Counter(tuple(r)[:6] for r in rows) == want
        for r in rows:
            listed = r["spans"].split(",") if r["spans"] else []
            assert len(listed) == sum(tuple(r)[1:5]) + r["n_added"]
        assert sum(r["n_added"] > 0 for r in rows) <= 0.01 * len(rows)
    assert pii.scan(rough.limit(0)).count() == 0
