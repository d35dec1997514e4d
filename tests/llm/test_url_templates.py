"""The url filter (op13) against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pyspark.sql.functions as F

from quaymetrics.llm import queries, url_templates

SF = "/root/testdata/sf0.001"
RULES = [
    ("net/", "net", "/", "block"), ("example.net/en/", "example.net", "/en/", "allow"),
    ("example.com/de/", "example.com", "/de/", "block"), ("org/fr/", "org", "/fr/", "allow"),
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def ruled(host, path):
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[0]), default=None)
    return (best[0], best[3]) if best else (None, None)


def shape(s):
    m = re.fullmatch(r"(.+)(\.[A-Za-z]{1,5})", s, re.S)
    stem, ending = (m[1], m[2]) if m else (s, "")
    for name, pattern in (("num", "[0-9]+"), ("hex", "[0-9A-Fa-f]{8,}"), ("word", "[^0-9]+")):
        if re.fullmatch(pattern, stem):
            return f"{{{name}}}{ending}"
    return f"{{mix}}{ending}"


def divergence(a, b, size):
    def share(c):
        total = sum(c.values()) + 0.5 * size
        return lambda k: (c[k] + 0.5) / total

    p, q = share(a), share(b)
    out = 0.0
    for k in range(size):
        m = (p(k) + q(k)) / 2
        out += 0.5 * (p(k) * math.log2(p(k) / m) + q(k) * math.log2(q(k) / m))
    return out


def model(rows, bucket):
    """{(host, segments): (template, labelled, purity)} of rows (host, segments, label)."""
    at_place = defaultdict(Counter)
    for host, segs, _ in rows:
        for k, s in enumerate(segs):
            at_place[host, k][s] += 1
    keep = {
        key: {s for s, n in c.items() if n >= 3 and n >= 0.01 * c.total()} for key, c in at_place.items()
    }
    raw = {
        (host, segs): tuple("=" + s if s in keep[host, k] else shape(s) for k, s in enumerate(segs))
        for host, segs, _ in rows
    }
    merged = {(host, raw[host, segs]): raw[host, segs] for host, segs, _ in rows}
    for at in range(max(map(len, raw.values()), default=0)):
        nodes = defaultdict(lambda: defaultdict(lambda: (Counter(), Counter())))
        for host, segs, label in rows:
            m = merged[host, raw[host, segs]]
            if len(m) > at:
                follow, labels = nodes[host, m[:at]][m[at]]
                follow[bucket("/".join(m[at + 1 :]))] += 1
                labels[("block", "allow", None).index(label)] += 1
        names = {}
        for node, found in nodes.items():
            heads, members = [], defaultdict(list)
            for token in sorted(found, key=lambda t: (-found[t][0].total(), t)):
                follow, labels = found[token]
                for head in heads:
                    a, b = found[head]
                    if divergence(a, follow, 32) <= 0.1 and divergence(b, labels, 3) <= 0.1:
                        members[head].append(token)
                        break
                else:
                    heads.append(token)
                    members[token].append(token)
            for head, tokens in members.items():
                for token in tokens:
                    names[node, token] = head if len(tokens) == 1 else f"{{{head}+}}"
        merged = {
            (host, r): (*m[:at], names[(host, m[:at]), m[at]], *m[at + 1 :]) if len(m) > at else m
            for (host, r), m in merged.items()
        }
    counts = defaultdict(Counter)
    for host, segs, label in rows:
        counts[host, merged[host, raw[host, segs]]][label] += 1
    out = {}
    for host, segs, _ in rows:
        m = merged[host, raw[host, segs]]
        c = counts[host, m]
        labelled = c["block"] + c["allow"]
        out[host, segs] = ("/".join(m), labelled, (c["block"] + 1) / (labelled + 2))
    return out


def check(spark, urls, got):
    """`urls` are (page_id, url)."""
    suffixes = {}
    cut = []
    for i, url in urls:
        host, path = parts(url)
        segs = [s for s in path.split("/") if s]
        segs = segs[:8] + (["/".join(segs[8:])] if len(segs) > 8 else [])
        cut.append((i, host, path, *ruled(host, path), tuple(segs)))

    def bucket(text):
        if text not in suffixes:
            row = spark.sql("select pmod(xxhash64(:t), 32) as b", args={"t": text}).first()
            suffixes[text] = row.b
        return suffixes[text]

    learned = model([(h, s, v) for _, h, _, _, v, s in cut], bucket)
    want = []
    for i, host, path, rule, verdict, segs in cut:
        name, _, share = learned[host, segs]
        verdict = verdict or ("block" if share >= 0.8 else "allow")
        want.append((i, host, path, rule, verdict, name, round(share, 9)))
    rows = [
        (r.page_id, r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9)) for r in got
    ]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    check(spark, [tuple(r) for r in pages], queries.QUERIES["op13_url_filter"](spark, SF).collect())


def test_made_hosts(spark):
    rng = random.Random(3)
    urls = []
    for k in range(900):
        host = rng.choice(["a.example.com", "A.Example.COM", "shop.example.net", "x.org", "net", "example.net"])
        kind = rng.choice(["/de/p/{}", "/en/p/{}", "/fr/{}.html", "/{}/fr/x", "/en/user/u{}/posts/{}", "/t/ab12cd34{}"])
        urls.append((k, f"http://{host}{kind.replace('{}', str(rng.randrange(300)))}"))
    got = url_templates.filter_urls(spark.createDataFrame(urls, "page_id long, url string"))
    check(spark, urls, got.collect())


def test_edges(spark):
    odd = [
        (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://net"), (6, "http://net/"),
        (7, "http://a.NET?x=/y"), (8, "http://anet/"), (9, "x://b.example.com/de"), (9, "x://b.example.com/de/"),
        (None, "http://example.net/en/1#2"), (None, None), (10, "http://a.org/fr//x///"), (10, "http://a.org/fr//x///"),
        (11, "http://org/fr/" + "s/" * 2000), (12, "http://É.com/=en/{num}/\n"), (13, "a://b://c/d"),
        (14, "http://h/" + "x" * 100_000), (15, "http://sub.example.net/EN/"),
    ]
    schema = "page_id long, url string, host string, n int, tokens string, _salt int, merged string"
    df = spark.createDataFrame([(*r, "h", 1, "t", 2, "m") for r in odd], schema)
    check(spark, odd, url_templates.filter_urls(df).collect())
    assert url_templates.filter_urls(df.limit(0)).count() == 0


def test_labels_spread_over_templates(spark):
    """A tenth of the pages is labelled; the others get the verdict of their template."""
    rng = random.Random(4)
    rows = []
    for k in range(4000):
        host = f"h{k % 4}"
        bad = rng.random() < 0.4
        segs = [rng.choice(["tag", "calendar"]), str(rng.randrange(10**6))] if bad else ["post", f"s{k}"]
        label = ("block" if bad else "allow") if rng.random() < 0.1 else None
        rows.append((k, host, segs, label, bad))
    df = spark.createDataFrame(
        rows, "page_id long, host string, segments array<string>, ruled string, bad boolean"
    )
    judged = url_templates.judge(df)
    assert judged.count() == 4000
    assert judged.where(F.col("rejected") != F.col("bad")).count() == 0
    names = {r.merged for r in judged.select("merged").distinct().collect()}
    assert any("+}" in n for n in names)
