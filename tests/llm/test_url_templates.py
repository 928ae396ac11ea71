"""Urls: parts, rules, and the tree of templates against a plain one."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from emberlog.llm import url_templates as U

KIND_NAMES = [k for k, _ in U.KINDS]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def plain_rule(host, path):
    best = None
    for verdict, rule in U.RULES:
        own, rest = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best or (None, None)


def plain_kind(segment):
    import re

    tests = [r"[0-9]+", r"[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?", r"(?=.*[0-9])[0-9a-fA-F-]{8,}", r"[^\W\d_]+"]
    if segment is None:
        return len(U.KINDS)
    for i, t in enumerate(tests):
        if re.fullmatch(t, segment):
            return i
    if re.search(r"\.[A-Za-z0-9]{1,5}$", segment):
        return 4
    return 5 if re.fullmatch(r"[^\W_]+([-_][^\W_]+)+", segment) else 6


def chi(a, b):
    cells = [(x, y) for x, y in zip(a, b, strict=True) if x + y]
    n, m = sum(x for x, _ in cells), sum(y for _, y in cells)
    if len(cells) < 2 or not n or not m:
        return 0.0, 0
    return sum((o - (x + y) * t / (n + m)) ** 2 / ((x + y) * t / (n + m)) for x, y in cells for o, t in ((x, n), (y, m))), len(cells) - 1


def alike(a, b):
    return all(score <= U.CHI_SQUARE[df - 1] for score, df in (chi(a[i], b[i]) for i in (1, 2)) if df)


def plain_tree(rows):
    """rows: host, segments, label. The template of each."""
    nodes = [""] * len(rows)
    for level in range(U.DEPTH):
        at = defaultdict(list)
        for i, (host, own, _) in enumerate(rows):
            if len(own) > level:
                at[host, nodes[i]].append(i)
        for members in at.values():
            count = Counter(rows[i][1][level] for i in members)
            named = {s for s, n in count.items() if n >= U.LEAST and n >= U.SHARE * len(members) and not set(s) & set("*{}|")}
            groups = {}
            for i in members:
                own, label = rows[i][1], rows[i][2]
                name = own[level] if own[level] in named else "*"
                g = groups.setdefault(name, ((name,), [0] * (len(U.KINDS) + 1), [0] * 3))
                g[1][plain_kind(own[level + 1] if len(own) > level + 1 else None)] += 1
                g[2][2 if label is None else 1 - label] += 1
            now = sorted(groups.values())
            while True:
                pairs = [(sum(abs(x / sum(a[k]) - y / sum(b[k])) for k in (1, 2) for x, y in zip(a[k], b[k], strict=True)), i, j) for i, a in enumerate(now) for j, b in enumerate(now) if i < j and alike(a, b)]
                if not pairs:
                    break
                _, i, j = min(pairs)
                a, b = now[i], now.pop(j)
                now[i] = tuple(sorted(a[0] + b[0])), [x + y for x, y in zip(a[1], b[1], strict=True)], [x + y for x, y in zip(a[2], b[2], strict=True)]
            name = {n: "*" if "*" in g[0] else "{" + "|".join(g[0]) + "}" if len(g[0]) > 1 else n for g in now for n in g[0]}
            for i in members:
                s = rows[i][1][level]
                nodes[i] += "/" + name[s if s in named else "*"]
    return [n + ("/**" if len(own) > U.DEPTH else "") for n, (_, own, _) in zip(nodes, rows, strict=True)]


def plain_judged(urls):
    parts = [plain_parts(u) for u in urls]
    said = [plain_rule(*p) for p in parts]
    rows = [(h, [s for s in p.split("/") if s], None if v is None else int(v == "block")) for (h, p), (v, _) in zip(parts, said, strict=True)]
    names = plain_tree(rows)
    count = Counter()
    for (h, _, label), t in zip(rows, names, strict=True):
        count[h, t, label] += 1
    purity = [(count[h, t, 1] + 1) / (count[h, t, 1] + count[h, t, 0] + 2) for (h, _, _), t in zip(rows, names, strict=True)]
    return [(h, p, r, v or ("block" if q >= U.PURITY else "allow"), t, q) for (h, p), (v, r), t, q in zip(parts, said, names, purity, strict=True)]


def made(seed, n=1500):
    r = random.Random(seed)
    hosts = ["A.example.com", "www.example.com", "x.www.example.com", "example.com", "com", "site.net", "b.site.net", "place.org", "place.org:80", "notcom", ""]
    pick = [lambda: r.choice(["en", "es", "fr", "de", "news", "shop"]), lambda: str(r.randrange(9999)), lambda: f"{r.randrange(99)}.html", lambda: "a-b-c", lambda: f"2024-0{r.randrange(1, 9)}", lambda: f"{r.getrandbits(40):010x}", lambda: "*", lambda: "", lambda: "überßtext"]
    out = []
    for _ in range(n):
        weights = [6, 3, 1, 1, 1, 1, 0.2, 0.5, 0.3]
        path = "".join("/" + (pick[0] if i == 0 and r.random() < 0.8 else r.choices(pick, weights)[0])() for i in range(r.randrange(5)))
        out.append(f"http://{r.choice(hosts)}{path}{r.choice(['', '', '?q=/es/', '#top', '/'])}")
    return out + [None, "", "no scheme/es/1", "://site.net/es/1", "a://b://c/d", "http://site.net\n/es/1", "HTTP://SITE.net/es/É", "http://place.org/" + "/".join(["seg"] * 40), "http://place.org/" + "y" * 100_000, "http://com"]


@pytest.mark.parametrize("seed", [1, 2])
def test_tree(spark, seed):
    urls = made(seed)
    urls += urls[:50]
    rows = [(i if i % 7 else None, u, "x", "t", 1, "n") for i, u in enumerate(urls)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, template string, label int, node string").repartition(3)
    got = sorted((repr(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"], r["template"] if len(r["path"]) < 9999 else "", round(r["purity"], 9)) for r in U.judged(frame).collect())
    assert got == sorted((repr(i if i % 7 else None), h, p, rule, v, t if len(p) < 9999 else "", round(q, 9)) for i, (h, p, rule, v, t, q) in enumerate(plain_judged(urls)))


def test_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: tuple(r[c] for c in ("host", "path", "rule", "verdict", "template")) for r in U.op13_url_filter(spark, "/root/testdata/sf0.01").collect()}
    rows = pages.select("page_id", "url").collect()
    assert got == {r["page_id"]: x[:5] for r, x in zip(rows, plain_judged([r["url"] for r in rows]), strict=True)}


def test_held_out_labels(spark):
    """Labels of two thirds of the urls decide on the rest, without rules."""
    r = random.Random(5)
    urls = [f"https://h{r.randrange(4)}.net/{r.choice(['casino', 'bets', 'news', 'wiki'])}/{r.randrange(10**6)}/{r.choice(['a', 'b'])}" for _ in range(3000)]
    bad = [any(w in u for w in ("casino", "bets")) ^ (r.random() < 0.02) for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bad) if i % 3] + [(1, None), (None, 1)], "page_id long, blocked int")
    got = U.judged(pages, (), labels).where(F.col("page_id") % 3 == 0).collect()
    assert sum((x["verdict"] == "block") == bad[x["page_id"]] for x in got) > 0.95 * len(got)
    assert {x["template"] for x in got} == {"/{bets|casino}/*/*", "/{news|wiki}/*/*"} or all(x["template"].endswith("*") or x["template"].split("/")[-1] in ("a", "b", "{a|b}") for x in got)


def test_no_rows(spark):
    assert U.judged(spark.createDataFrame([], "page_id long, url string")).collect() == []
    only = U.judged(spark.createDataFrame([(1, None), (None, None)], "page_id long, url string")).collect()
    assert [(x["host"], x["path"], x["rule"], x["verdict"]) for x in only] == [("", "", None, "allow")] * 2
