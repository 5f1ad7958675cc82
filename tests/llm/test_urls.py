import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tabflow.llm.urls import RULES, url_verdicts

FOLDER = "/root/testdata/sf0.01"
VARIABLE = re.compile(r"(?<=/)(?:[0-9]+|[0-9a-fA-F-]{8,}|[^/]{40,}?)(?:\.[A-Za-z0-9]{1,5})?(?=/|$)")


def parse(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]) if m else ("", "")


def ruled(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute(pages, labels, depth=4, least=5, z=2.6, prior=20.0):
    """The tree node by node."""
    info = {}
    for key, url in pages:
        host, path = parse(url)
        m = re.search(r"([0-9]{1,18})[^0-9/]*/*$", path)
        info[key] = (host, path, re.sub("/+$", "", VARIABLE.sub("*", path)).split("/"), labels.get(int(m[1])) if m else None)
    prefix = dict.fromkeys(info, "")
    for d in range(1, depth + 1):
        nodes = defaultdict(lambda: defaultdict(list))
        for k, (host, _, parts, bad) in info.items():
            if len(parts) > d:
                nodes[host, prefix[k]][parts[d]].append(bad)
        stays = set()
        for node, children in nodes.items():
            known = {c: [b for b in x if b is not None] for c, x in children.items()}
            lab, bad = sum(map(len, known.values())), sum(map(sum, known.values()))
            for c, x in known.items():
                rest = lab - len(x)
                if c != "*" and len(children[c]) >= least and x and rest:
                    share = bad / lab
                    error = math.sqrt(share * (1 - share) * (1 / len(x) + 1 / rest))
                    if error > 0 and abs(sum(x) / len(x) - (bad - sum(x)) / rest) >= z * error:
                        stays.add((*node, c))
        prefix = {k: p + "/" + (info[k][2][d] if (info[k][0], p, info[k][2][d]) in stays else "*") if len(info[k][2]) > d else p for k, p in prefix.items()}
    prefix = {k: p + "/**" if len(info[k][2]) > depth + 1 else p for k, p in prefix.items()}
    bads = [x[3] for x in info.values() if x[3] is not None]
    overall = sum(bads) / len(bads) if bads else 0.0
    by_host, by_template = defaultdict(list), defaultdict(list)
    for k, (host, _, _, bad) in info.items():
        if bad is not None:
            by_host[host].append(bad)
            by_template[host, prefix[k]].append(bad)
    out = []
    for k, (host, path, _, _) in info.items():
        h = (sum(by_host[host]) + prior * overall) / (len(by_host[host]) + prior)
        x = by_template[host, prefix[k]]
        purity = 1 - (sum(x) + prior * h) / (len(x) + prior)
        rule, verdict = ruled(host, path)
        out.append((k, host, path, rule, verdict or ("block" if purity < 0.5 else "allow"), prefix[k], len(x), round(purity, 9)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((*tuple(r)[:-1], round(r.purity, 9)) for r in df.collect()), key=str)


def planted():
    """Good and bad branches below one host, numbered pages, and odd urls."""
    urls, bad = [], {}
    for i in range(600):
        branch = ("news", "deals", "blog")[i % 3]
        urls.append((i, f"https://Shop.example.NET/{branch}/x{i % 2}/{i}.html?q=1#t"))
        if i % 2:
            bad[i] = int(branch == "deals") if i % 11 else 1
    urls += [(1000 + i, f"http://many.example.net/slug-{i}-{i * i}") for i in range(80)]
    odd = [None, "", "no scheme/x", "x://", "x://H", "x://h?a/b", "x://a.org/fr/1", "x://org/", "x://example.org/es/2", "x://b.example.org/en/12", "x://b.example.org/en/2", "x://com/fr/é/ü/a/b/c/d/e",
           "x://x.com/de/", "x://notorg/", "x://a//b//9", "a://b://c/d", "x://h/%2F/*/**", "x://h/" + "y" * 50_000]
    return urls + [(2000 + i, u) for i, u in enumerate(odd)], bad


def test_tree_equals_brute_force(spark):
    urls, bad = planted()
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit(1))
    labels = spark.createDataFrame([(k, 1 - v, 0) for k, v in bad.items()] + [(None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = rows(url_verdicts(pages, labels))
    assert got == brute(urls, bad)
    verdicts = Counter((x[5], x[4]) for x in got if x[1] == "shop.example.net")
    assert set(verdicts) >= {("/deals/*/*", "block"), ("/news/*/*", "allow")}


def test_pages_equal_brute_force(spark):
    pages, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("pages", "labels"))
    plan = url_verdicts(pages, labels)
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
    bad = {r.doc_id: int(r.quality == 0 or r.toxic == 1) for r in labels.collect()}
    assert rows(plan) == brute([(r.page_id, r.url) for r in pages.collect()], bad)


def test_empty_and_repeated(spark):
    pages = spark.createDataFrame([(1, "x://a.net/b/1"), (1, "x://a.net/b/1"), (None, None)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted((r.page_id or 0, r.host, r.verdict, r.purity) for r in url_verdicts(pages, labels).collect()) == [(0, "", "allow", 1.0), (1, "a.net", "allow", 1.0), (1, "a.net", "allow", 1.0)]
    assert url_verdicts(pages.limit(0), labels).count() == 0


def test_many_siblings(spark):
    """A bad section stays apart from the others, however many segments its node has."""
    urls = [(i, f"x://big.net/{'deals' if i % 2 else 'news'}/{i}") for i in range(200)] + [(1000 + i, f"x://big.net/rare-{i}") for i in range(300)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = Counter((r.template, r.verdict) for r in url_verdicts(pages, labels).collect() if r.page_id < 1000)
    assert got == {("/deals/*", "block"): 100, ("/news/*", "allow"): 100}
