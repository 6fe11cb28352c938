import random
import re

from tieplane.llm.licenses import NOTICES, notices, scan_licenses

from .cases import frame, texts


def shingles(text):
    w = [x for x in re.split(r"[^\w]|_", text.lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(rows, templates):
    out = set()
    for d, t in rows:
        s = shingles(t or "")
        for name, text in templates:
            own = set(shingles(text))
            if not own:
                continue
            n = len(own)
            held = [(len(set(s[a : a + 2 * n]) & own) / n, -a) for a in range(0, max(1, len(s)), n)]
            held = [h for h in held if h[0] * 100 >= 80]
            if held:
                best = max(held)
                out.add((d, name, best[0], -best[1], len(held)))
    return out


def test_planted_notices_are_found_wherever_they_stand(spark):
    rng = random.Random(7)
    rows, base = [], [(d, t) for d, t in texts(3) if t and d is not None and 100 <= d < 160]
    for k, (d, t) in enumerate(base):
        words, (_, notice) = t.split(), NOTICES[k % len(NOTICES)]
        at = rng.randint(0, len(words))
        rows.append((d, " ".join([*words[:at], notice.upper() if k % 3 == 0 else notice, *words[at:]])))
    clean = [(d, t) for d, t in texts(4) if d is None or d < 100 or d >= 160]
    got = {tuple(r) for r in scan_licenses(frame(spark, rows + clean), notices(spark)).collect()}
    assert got == brute(rows + clean, NOTICES)
    assert {d for d, *_ in got} == {d for d, _ in rows}


def test_changed_notices(spark):
    name, text = NOTICES[4]
    words = text.split()
    one = [*words[:20], "x", *words[21:]]
    many = ["x" if i % 4 == 0 else w for i, w in enumerate(words)]
    rows = [(1, " ".join(one)), (2, " ".join(many)), (3, " ".join(words[: len(words) // 2])), (4, text + " " + text)]
    got = {tuple(r) for r in scan_licenses(frame(spark, rows), notices(spark)).collect()}
    assert got == brute(rows, NOTICES) and {g[0] for g in got if g[1] == name} == {1, 4}


def test_no_templates_and_no_rows(spark):
    rows = [(1, NOTICES[0][1])]
    assert scan_licenses(frame(spark, rows), notices(spark).filter("template = 'none'")).collect() == []
    assert scan_licenses(frame(spark, []), notices(spark)).collect() == []
    odd = spark.createDataFrame([("short", "two words"), (None, "a b c d e f"), ("null", None)], "template string, text string")
    assert scan_licenses(frame(spark, [(1, "a b c d e f")]), odd).collect() == []


def test_templates_of_fewer_words_than_a_shingle(spark):
    rows = [(1, "All rights reserved."), (2, "x y z. ALL RIGHTS\nreserved, and all-rights reserved"), (3, "all rights"), (4, "all the rights reserved"), (5, None), (6, NOTICES[0][1] + " All rights reserved."), (6, "all rights reserved")]
    short = [("all-rights-reserved", "All rights reserved."), ("one", "Y"), ("four", "and all rights reserved"), ("none", " .")]

    def planted(templates):
        out = {}
        for d, t in rows:
            w = [x for x in re.split(r"[^\w]|_", (t or "").lower()) if x]
            for name, text in templates:
                own = [x for x in re.split(r"[^\w]|_", text.lower()) if x]
                for p in range(len(w) - len(own) + 1) if own else []:
                    if w[p : p + len(own)] == own:
                        out.setdefault((d, name), set()).update({p, max(p - 1, 0)})
        return {(*k, 1.0, min(v), len(v)) for k, v in out.items()}

    got = {tuple(r) for r in scan_licenses(frame(spark, rows), spark.createDataFrame(short, "template string, text string")).collect()}
    assert got == planted(short) and {g[0] for g in got if g[1] == "all-rights-reserved"} == {1, 2, 6}
    both = {tuple(r) for r in scan_licenses(frame(spark, rows), notices(spark)).collect()}
    assert both == planted(short[:1]) | brute(rows, NOTICES) and (6, NOTICES[0][0]) in {g[:2] for g in both}


def test_a_text_of_a_million_words_with_a_notice(spark):
    words = [f"w{i % 9973}" for i in range(1_000_000)]
    for at, (_, notice) in zip((10, 300_001, 999_000), (NOTICES[0], NOTICES[4], NOTICES[7]), strict=True):
        words[at : at + len(notice.split())] = notice.split()
    got = {tuple(r) for r in scan_licenses(frame(spark, [(1, " ".join(words)), (2, "short")]), notices(spark)).collect()}
    assert {(g[0], g[1]) for g in got} == {(1, NOTICES[k][0]) for k in (0, 4, 7)}
    assert got == brute([(1, " ".join(words))], NOTICES)


def test_more_templates_than_one_pass_takes(spark, monkeypatch):
    from tieplane.llm import licenses

    monkeypatch.setattr(licenses, "TEMPLATES", 3)
    rows = [(k, f"before {t} after") for k, (_, t) in enumerate(NOTICES)]
    got = {tuple(r) for r in scan_licenses(frame(spark, rows), notices(spark)).collect()}
    assert got == brute(rows, NOTICES)
