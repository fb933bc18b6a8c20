from __future__ import annotations

import re

from quillfold.llm import hosts

PAGES = [
    (1, "HTTP://WWW.Example.com/en/a?b#c", None), (2, "https://example.com/en/", ""), (3, "x.example.com/en/", "<a href='//h.org'>"),
    (4, None, None), (5, "ftp://good.com/x://y", '<a href="http://blog.org/p">'), (6, "https://blog.org", "<a HREF = http://far.org/1?x>"),
    (7, "https://bad.net/es/1", "<a href='/rel'>"), (8, "https://bad.net/en/1", ""), (9, "https://pointer.org/x", '<a href="https://bad.net/fr/">'),
    (10, "https://notcom/", ""), (11, "https://far.org?q=1://2", '<a href="https://bad.net/1"><a href="https://blog.org/2">'), (11, "https://far.org?q=1://2", None),
    (12, "://", ""), (13, "https://example.com/EN/", ""), (14, "https://a.www.example.com/en/\nx", ""),
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in hosts.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_scores(pages):
    links, seen = {}, {}
    for _, url, html in pages:
        src, path = plain_parts(url)
        if src:
            seen.setdefault(src, []).append(plain_rule(src, path)[1])
        for to in re.findall(r"""(?i)\b(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)""", html or ""):
            dst = plain_parts("x:" + to if to.startswith("//") else to)[0]
            if src and dst and src != dst:
                links[src, dst] = links.get((src, dst), 0) + 1
    names = set(seen) | {h for e in links for h in e}
    start = {h: [0.15 * seen.get(h, []).count(v) / max(1, len(seen.get(h, []))) for v in ("allow", "block")] for h in names}
    out, into = {}, {}
    for (a, b), n in links.items():
        out[a], into[b] = out.get(a, 0) + n, into.get(b, 0) + n
    now = {h: list(v) for h, v in start.items()}
    for _ in range(hosts.ROUNDS):
        new = {h: list(v) for h, v in start.items()}
        for (a, b), n in links.items():
            new[b][0] += 0.85 * n / out[a] * now[a][0]
            new[a][1] += 0.85 * n / into[b] * now[b][1]
        now = new
    return now


def test_equals_brute_force(spark):
    pages = [*PAGES, *((100 + i, f"https://h{i % 7}.org/{i}", f'<a href="https://h{(i * i) % 7}.org/"><a href="https://{"good.com" if i % 3 else "bad.net"}/">') for i in range(40))]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    found = hosts.judge(frame).collect()
    scores = plain_scores(pages)
    assert len(found) == len(pages)
    want = {}
    for page, url, _ in pages:
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        trust, distrust = scores.get(host, (0.0, 0.0))
        says = "block" if distrust > trust and distrust >= hosts.THRESHOLD else "allow"
        want[page] = (host, path, rule, verdict or says, round(trust, 9), round(distrust, 9))
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict, round(r.trust, 9), round(r.distrust, 9)) == want[r.page_id]
    verdicts = {r.page_id: r.verdict for r in found}
    assert verdicts[8] == "block" and verdicts[6] == "allow" and verdicts[4] == "allow"


def test_no_rows(spark):
    assert hosts.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
