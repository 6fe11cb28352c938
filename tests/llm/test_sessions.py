import random
import zlib
from collections import Counter, defaultdict

import pytest

from tieplane.llm import sessions


def expected(events, gap=600):
    """Sessions of all events so far, anew after each batch."""
    users, out = defaultdict(list), []
    for u, s, b, h in events:
        if None not in (u, s, b):
            users[u].append((s, b, h or 0))
    for u, rows in users.items():
        standing = []  # (start, end, row)
        for batch in sorted({b for _, b, _ in rows}):
            active = sorted(r for r in rows if r[1] <= batch)
            groups = [[active[0]]]
            for r in active[1:]:
                if r[0] - groups[-1][-1][0] <= gap:
                    groups[-1].append(r)
                else:
                    groups.append([r])
            for g in groups:
                new = sum(b == batch for _, b, _ in g)
                if not new:
                    continue
                start, end = g[0][0], g[-1][0]
                old = [v for v in standing if start <= v[0] and v[1] <= end]
                standing = [v for v in standing if v not in old]
                for v in old:
                    v[2][8:] = [batch, start]
                row = [u, batch, start, end, len(g), new, len(old), sum(h for *_, h in g), None, None]
                standing.append((start, end, row))
                out.append(row)
    return Counter(map(tuple, out))


def run(spark, events, **more):
    df = spark.createDataFrame(events, "user long, seconds long, batch long, h long").selectExpr("*", "1L AS n", "2 AS kind", "'x' AS block")
    return Counter(map(tuple, sessions.merge_sessions(df, **more).collect()))


def late(seed, users=12, n=60, span=20_000, delay=6):
    rng = random.Random(seed)
    out = []
    for u in range(users):
        for _ in range(rng.randint(1, n)):
            s = rng.randrange(rng.choice([2000, span]))
            out.append((u, s, s // 900 + rng.choice([0, 0, 0, rng.randint(0, delay)]), rng.randrange(2**32)))
    return out + out[:5] + [(None, 1, 1, 1), (1, None, 1, 1), (1, 1, None, 1), (2, 5, 0, None)]


def test_one_block_a_user(spark):
    events = late(1)
    assert run(spark, events) == expected(events)


@pytest.mark.parametrize("block, span, delay", [(601, 2, 3), (2000, 2, 40), (5000, 256, 6)])
def test_sessions_over_many_blocks(spark, block, span, delay):
    events = late(block, delay=delay)
    assert run(spark, events, block=block, span=span) == expected(events)


def test_one_session_of_one_user_over_hundreds_of_blocks(spark):
    rng = random.Random(5)
    events = [(7, 250 * k, 250 * k // 900 + rng.choice([0, 0, 1, 3]), k) for k in range(2000)] + [(7, 250 * 900 + 1, 4000, 1), (7, -3000, 9, 5)]
    rng.shuffle(events)
    assert run(spark, events, block=1000, span=8) == expected(events)


def test_times_at_the_gap(spark):
    events = [(1, 0, 0, 1), (1, 600, 0, 2), (1, 1201, 0, 4), (1, 1200, 2, 8), (2, 0, 3, 1), (2, 0, 1, 1), (2, 601, 1, 1)]
    assert run(spark, events) == expected(events)
    assert run(spark, events, block=700) == expected(events)


def test_empty(spark):
    assert run(spark, []) == Counter()
    assert run(spark, [(None, 1, 1, 1)]) == Counter()


def test_events_of_conversations(spark):
    rows = [(c, t, None) for c in (0, 5, 9, 123456) for t in (0, 1, 17)] + [(3, None, "x"), (None, 2, "y")]
    got = Counter(map(tuple, sessions.conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()))
    want = Counter()
    for conv, turn, _ in rows:
        if None not in (conv, turn):
            c, h = zlib.crc32(b"%d" % conv), zlib.crc32(b"%d:%d" % (conv, turn))
            g, s = h // 600, c // 2 % 7200 + 300 * turn + h % 600
            want[2 * (conv // 8) + c % 2, s, s // 900 + (g % 4 if g % 5 == 0 else 0), h] += 1
    assert got == want
