import random
import re

import pyarrow as pa

from thalweg.llm.url_filter import GlobSet, Rule, filter_urls, parse_glob

RULES = [Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/")]
URLS = [
    None, "", "no scheme", "http://", "http://X.Example.COM/en/1?x#y", "https://www.example.com/en/", "https://wwww.example.com/en/x",
    "http://a.www.example.com/en/x", "http://example.com", "http://example.com?/en/", "http://example.com#/en/", "http://example.com/EN/",
    "a://b://com/", "http://ÉÀ.net/es/ü", "http://xnet/es/", "http://.net/es/", "http://q.net/x.net/es/", "ftp://com/", "http://u:p@b.com:80/", "http://x.org/a/ads/b",
    "http://x.org/" + "a/" * 5000 + "ads/z", "x\n://y.net/es/\n",
]


def brute(url):
    m = re.search("://", url or "")
    rest = url[m.end() :] if m else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    verdict = best.verdict if best else "block" if re.fullmatch(r"(?s).*/ads/.*", host + path) else "allow"
    return host, path, best and best.text, verdict


def test_against_brute_force(spark):
    rows = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS + URLS[:3])], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(rows, RULES, ["**/ads/**"]).collect()}
    for k, u in enumerate(URLS + URLS[:3]):
        assert got[k] == brute(u), u
    assert filter_urls(rows.limit(0), RULES).count() == 0
    assert filter_urls(rows, []).where("verdict = 'allow' and rule is null").count() == len(URLS) + 3


def test_globs_against_regex():
    rng = random.Random(3)
    globs = ["".join(rng.choices(["a", "b", "/", "*", "**", "?", "."], k=rng.randint(0, 7))) for _ in range(120)]
    subjects = ["".join(rng.choices("ab/.", k=rng.randint(0, 9))) for _ in range(400)]

    def regex(g):
        return "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|.", g))

    s = GlobSet([parse_glob(g) for g in globs])
    for p in range(len(globs)):
        got = s.first_match(pa.array(subjects), [p])
        assert [x == p for x in got.tolist()] == [bool(re.fullmatch(regex(globs[p]), x)) for x in subjects], globs[p]
