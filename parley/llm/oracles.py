"""SQL that gives the rows of the operators SQL can express."""

from __future__ import annotations

from . import urls
from .decontaminate import WINDOW
from .warc import LEAST

WARC = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages), d AS (SELECT page_id, url, strlen(body)::BIGINT AS n, sha1(body) AS digest FROM p),
k AS (SELECT digest, max(page_id) AS keeper FROM d WHERE n >= {LEAST} GROUP BY digest)
SELECT page_id, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url, n AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN n >= {LEAST} AND page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= {LEAST} AND page_id < keeper THEN keeper END AS refers_to
FROM d LEFT JOIN k ON d.digest = k.digest"""

_WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH b AS (SELECT item_id, row_number() OVER () AS r, {_WORDS.format(t="text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT item_id, r, i - 1 AS off, least({WINDOW}, len(w)) AS size, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS gram FROM (SELECT item_id, r, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({_WORDS.format(t="text")}, []) AS w FROM documents),
spots AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size),
hit AS (SELECT DISTINCT a.doc_id, a.i, a.size, win.item_id, win.r, win.off FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM spots) a JOIN win ON win.size = a.size AND win.gram = a.gram),
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hit),
found AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
runs AS (SELECT doc_id, item_id::VARCHAR AS name, min(i) - 1 AS doc_at, min(off) AS item_at, count(*) + min(size) - 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, r, size, i - off ORDER BY i) AS run FROM hit) GROUP BY doc_id, r, item_id, size, i - off, run),
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, doc_at, name, item_at) = 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(f.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.names, '')) AS items_sha256, f.n_hit IS NOT NULL AS contaminated,
  coalesce(l.n, 0)::INT AS longest_hit, l.doc_at::INT AS longest_at, l.name AS longest_item, l.item_at::INT AS item_at
FROM d LEFT JOIN found f USING (doc_id) LEFT JOIN items i USING (doc_id) LEFT JOIN longest l USING (doc_id)"""


def _urls() -> str:
    ordered = sorted(urls.RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered)
    name = "host"
    for pattern in urls.STRIPPED:
        name = f"regexp_replace({name}, '{pattern}', '')"
    number, two = f"regexp_matches(name, '{urls.ADDRESS}')", f"regexp_matches(name, '{urls.TWO_LABELS}')"
    last = lambda n: f"regexp_extract(name, '([^.]*[.]){{0,{n - 1}}}[^.]*$')"
    a, b, ctes = "(c.mean * s.s + c.bad)", "((1 - c.mean) * s.s + c.n - c.bad)", []
    low, high = urls.LEAST_STRENGTH, urls.MOST_STRENGTH
    for level, parent in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        source = f"(SELECT {level}, {parent + ', ' if parent else ''}sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL) g"
        mean = f"JOIN {parent}_post q ON g.{parent} = q.{parent}" if parent else "CROSS JOIN (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS mean FROM hosts) q"
        ctes.append(f"{level}_c AS (SELECT g.{level}, g.n::DOUBLE AS n, g.bad::DOUBLE AS bad, q.mean FROM {source} {mean})")
        ctes.append(f"{level}_m AS (SELECT sum(n * pow(bad / n - mean, 2)) - sum(mean * (1 - mean)) AS more, sum(mean * (1 - mean) * (n - 1)) AS room FROM {level}_c WHERE n > 0)")
        ctes.append(f"{level}_r AS (SELECT greatest(0, coalesce(more / nullif(room, 0), 0)) AS rho FROM {level}_m)")
        ctes.append(f"{level}_s AS (SELECT coalesce(least({high}, greatest({low}, (1 - rho) / nullif(rho, 0))), {high})::DOUBLE AS s FROM {level}_r)")
        ctes.append(f"{level}_post AS (SELECT c.{level}, c.n, c.bad, {a} AS a, {b} AS b, {a} / ({a} + {b}) AS mean FROM {level}_c c, {level}_s s)")
    return f"""
WITH parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
known AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
named AS (SELECT host, {name} AS name, count(k.bad) AS n, coalesce(sum(k.bad), 0) AS bad FROM parts LEFT JOIN known k USING (page_id) GROUP BY host),
hosts AS (SELECT host, n, bad, CASE WHEN {number} THEN name WHEN {two} THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN {number} THEN name WHEN {two} THEN {last(2)} ELSE {last(1)} END AS suffix FROM named),
{", ".join(ctes)},
post AS (SELECT host, n, bad, mean, greatest(0, mean - {urls.DEVIATIONS} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) AS low FROM host_post)
SELECT p.page_id, p.host, p.path, CASE {rule} END AS rule, CASE {verdict} WHEN low > {urls.THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict, n::BIGINT AS labelled, bad::BIGINT AS bad, round(mean, 9) AS bad_rate, round(low, 9) AS bad_low
FROM parts p LEFT JOIN (SELECT host AS of_host, n, bad, mean, low FROM post) o ON p.host = o.of_host"""


URLS = _urls()
