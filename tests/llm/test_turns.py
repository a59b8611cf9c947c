import hashlib
import re
import zlib
from collections import defaultdict

from hypothesis import HealthCheck, given, settings, strategies as st

from floodframe.llm import turns
from floodframe.llm.common import prepare

SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def trie(spark, rows):
    prepare(spark)
    out = turns.prefix_trie(turns.rebuilt(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)))
    return sorted(tuple(r) for r in out.collect())


def brute(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            talks[c].append(((turn is not None, turn or 0, key), (role, text)))
    talks = {c: [t for _, t in sorted(v)] for c, v in talks.items()}
    built = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = talks.get(c - c % 20, [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * (words(p[-1][1]) if p else 0) for p in below)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(path)))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def same(spark, rows):
    assert trie(spark, rows) == brute(rows)


def test_shared_openings_nulls_and_repeats(spark):
    rows = [(c, t, "user" if t % 2 == 0 else None, None if t == 3 else f"turn {t % 3} of {c % 2}") for c in range(0, 24) for t in range(c % 7)]
    rows += [(25, None, "user", "first"), (25, 0, "user", "second"), (25, 0, "user", "second"), (25, 0, "a", "b"), (None, 1, "user", "nobody")]
    same(spark, rows)


def test_copies_turnless_and_absent_bases(spark):
    rows = [(c, 0, "user", "hello there all") for c in range(60, 90)] + [(c, 1, "bot", "yes") for c in range(70, 80)]
    rows += [(c, 0, "user", "only one") for c in range(201, 212)]  # no conversation 200
    same(spark, rows)


def test_more_turns_than_a_block_and_a_slice(spark, monkeypatch):
    monkeypatch.setattr(turns, "SLICE", 4)
    rows = [(c, t, "u", f"w{t} " * (t % 3)) for c in (0, 1, 2, 40) for t in range(8 * c % 50 + 8)]
    rows += [(3, t, "u", "same") for t in range(70)] + [(4, t, "u", "same") for t in range(64)] + [(5, 5, "u", str(k)) for k in range(20)]
    same(spark, rows)


def test_empty_table(spark):
    assert trie(spark, []) == []


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-25, 45), st.one_of(st.none(), st.integers(0, 12)), st.sampled_from(["a", "b", None]), st.sampled_from(["", "x", "x y", None, "é"])), max_size=60))
def test_random_tables(spark, rows):
    rows = [(c if c >= 0 else None, *r) for c, *r in rows]
    same(spark, rows)
