"""DuckDB SQL for the URL filter's query: the same steps as the operator's, in one statement."""

from __future__ import annotations

from tessel.llm.url_filter import BOUND, STRONG, WEAK, WORSE, Rule


def _strength(t: str) -> str:
    return f"""SELECT (1 - r) / r AS k FROM (SELECT least(greatest(CASE WHEN coalesce(room, 0) > 0 THEN over_ / room ELSE 0 END, {1 / (STRONG + 1)!r}::DOUBLE), {1 / (WEAK + 1)!r}::DOUBLE) AS r
  FROM (SELECT sum(n * (s / n - p) * (s / n - p) - p * (1 - p)) AS over_, sum(p * (1 - p) * (n - 1)) AS room FROM {t} WHERE n > 0))"""


#: Each page with its outcome: the label of the documents whose letters it has.
MATCHED = "SELECT dom.*, good FROM dom LEFT JOIN good USING (digest)"


def url_sql(rules: list[Rule], seen: str = MATCHED) -> str:
    """Outcomes (by default by matching texts), counts, shrinking from all to suffix, domain and host, then rules."""
    values = ", ".join(f"({i}, '{verdict}', '{host}', '{path}')" for i, (verdict, host, path) in enumerate(rules))
    letters = r"'[^\p{L}\p{N}]+'"
    two = r"regexp_extract(bare, '((?:ac|co|com|edu|gov|net|org)\.[a-z]{2})$', 1)"
    label = r"regexp_extract(left(bare, length(bare) - length(suffix)), '([^.]+)\.$', 1)"
    return rf"""WITH marks AS (SELECT sha256(regexp_replace(coalesce(text, ''), {letters}, '', 'g')) AS digest, quality FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)),
good AS (SELECT digest, CASE WHEN 2 * sum(quality) >= count(*) THEN 1 ELSE 0 END AS good FROM marks GROUP BY 1),
cut AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<article\b[^>]*>(?:\s*<h1\b.*?</h1\s*>)?(.*?)</article\s*>', 1), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g') AS t FROM pages),
site AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
  sha256(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), {letters}, '', 'g')) AS digest FROM cut),
bared AS (SELECT *, regexp_replace(host, '^.*@|:[0-9]*$|\.$', '', 'g') AS bare FROM site),
suf AS (SELECT *, CASE WHEN {two} NOT IN ('', bare) THEN {two} ELSE regexp_extract(bare, '([^.]*)$', 1) END AS suffix FROM bared),
dom AS (SELECT *, CASE WHEN {label} = '' THEN bare ELSE {label} || '.' || suffix END AS domain FROM suf),
seen AS ({seen}),
h AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, coalesce(sum(good), 0)::DOUBLE AS s, count(good)::DOUBLE AS n FROM seen GROUP BY 1),
g AS (SELECT (sum(s) + 1) / (sum(n) + 2) AS p FROM h),
s1 AS (SELECT suffix, sum(s) AS s, sum(n) AS n, max(g.p) AS p FROM h CROSS JOIN g GROUP BY 1), k1 AS ({_strength("s1")}), ps AS (SELECT suffix, (k * p + s) / (k + n) AS p FROM s1 CROSS JOIN k1),
d1 AS (SELECT domain, sum(s) AS s, sum(n) AS n, max(p) AS p FROM h JOIN ps USING (suffix) GROUP BY 1), k2 AS ({_strength("d1")}), pd AS (SELECT domain, (k * p + s) / (k + n) AS p FROM d1 CROSS JOIN k2),
h1 AS (SELECT host, s, n, p FROM h JOIN pd USING (domain)), k3 AS ({_strength("h1")}), ab AS (SELECT host, k * p + s AS a, k * (1 - p) + n - s AS b FROM h1 CROSS JOIN k3),
bound AS (SELECT host, a / (a + b) AS rate, least(a / (a + b) + {BOUND} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 1.0) AS upper, p / (p + {WORSE} * (1 - p)) AS level FROM ab CROSS JOIN g),
rules AS (SELECT * FROM (VALUES {values}) r(i, what, rhost, rpath)),
fit AS (SELECT page_id, rhost || rpath AS rule, what, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, i) AS rn
  FROM dom JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT dom.page_id, dom.host, path, rule, coalesce(what, CASE WHEN upper < level THEN 'block' ELSE 'allow' END) AS verdict, round(rate, 6) AS rate, round(upper, 6) AS upper
FROM dom JOIN bound ON bound.host = dom.host LEFT JOIN fit ON fit.page_id = dom.page_id AND rn = 1"""
