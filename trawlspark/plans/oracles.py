"""Plain SQL with the same results as the registered queries."""

from __future__ import annotations

from .queries import (
    BUDGETS,
    DAY,
    LEVEL_DEPTH,
    LOG_RULE,
    LOG_TIMEOUT_MS,
    MAP_DEPTH,
    MAX_BYTES,
    MID_MONTH_MS,
    RETENTION_ASOF_MS,
    ROBOTS_CONFIG_MS,
    STALE_ASOF_MS,
)

# --- shared parts -----------------------------------------------------------------

PAGES = """p AS (
  SELECT page_id, url, html,
    regexp_extract(url, '^https?://[^/?#]*') AS site,
    regexp_extract(url, '^https?') AS scheme,
    regexp_replace(url, '#.*', '') AS uri,
    regexp_replace(url, '[?#].*', '') AS bare,
    substr(regexp_replace(url, '[?#].*', ''),
           length(regexp_extract(url, '^https?://[^/?#]*')) + 1) AS path
  FROM pages)"""

SITES = "s AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/?#]*') AS site FROM pages)"

MESSY = """v AS (
  SELECT page_id, variant, scheme, site, path, bare,
    CASE variant
      WHEN 0 THEN url
      WHEN 1 THEN scheme || '://' || upper(substr(site, length(scheme) + 4)) || path
      WHEN 2 THEN site || CASE scheme WHEN 'https' THEN ':443' ELSE ':80' END || path
      WHEN 3 THEN bare || '?b=2&a=1&b=3'
      WHEN 4 THEN bare || '?jsessionid=abc&z=1'
      WHEN 5 THEN site || '/x/../.' || path
      WHEN 6 THEN bare || '?q=a b&r=%7Ex<y>'
      ELSE bare || '?id===' END AS url,
    CASE variant
      WHEN 0 THEN uri
      WHEN 3 THEN bare || '?a=1&b=3'
      WHEN 4 THEN bare || '?z=1'
      WHEN 6 THEN bare || '?q=a+b&r=~x%3Cy%3E'
      WHEN 7 THEN NULL
      ELSE bare END AS uri
  FROM p, (SELECT unnest(range(8)) AS variant))"""

HREFS = """h AS (
  SELECT page_id, p.uri AS page_uri, site, unnest(regexp_extract_all(html,
    '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
    unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS txt
  FROM p)"""

ENCODED = "replace(replace(url_encode(href), '%2F', '/'), '%2C', ',')"

LINKS = f"l AS (SELECT DISTINCT page_id, page_uri, site, href, txt, site || {ENCODED} AS uri FROM h)"


# The page rules in the order they are tried, written out: accepted or not, and the pattern.
AS_WRITTEN = [
    (False, "https?://[^/]*cheap-pills"),
    (True, "http://blog[.]"),
    (False, "http://[^?]*[.]html"),
    (True, "https://(www|m)[.]"),
    (True, "(?i)HTTP://"),
    (False, "https://[^/]*/fr/"),
    (True, "https://[^/]*/(fr|de)/"),
]
REJECTS_FIRST = [
    (False, "https?://[^/]*cheap-pills"),
    (False, "http://[^?]*[.]html"),
    (False, "https://[^/]*/fr/"),
    (True, "http://blog[.]"),
    (True, "https://(www|m)[.]"),
    (True, "(?i)HTTP://"),
    (True, "https://[^/]*/(fr|de)/"),
]

# Messages of configuration checks, state and message of each outcome.
NO_AGENT = (
    "Please set a sensible userAgent value in your crawler configuration."
    "This is used to form a User-agent header during HTTP fetch requests "
    "to help identify your crawler to the web server. Some web servers will "
    "block requests if a user agent is not defined. "
    "The user agent is also used when evaluating Robots Exclusion rules."
)
NO_SEEDS = "seed URIs are required to start a crawler"
OUTCOME_TEXTS = [
    ("Completed", "Completed Okay"),
    ("Aborted", "Too many URIs queued for crawling"),
    ("Aborted", "Crawl exceeded maximum fetch requests"),
    ("Aborted", "Too many failed fetches"),
]


def rule_case(uri: str, rules: list[tuple[bool, str]], what: str) -> str:
    """CASE over the page rules; ``what`` is accepted, pattern or text."""
    out = []
    for accept, regex in rules:
        value = {
            "accepted": str(accept).lower(),
            "pattern": f"'{regex}'",
            "text": f"'The URI [' || {uri} || '] is {'accepted' if accept else 'rejected'}"
            f" by pattern [{regex}]'",
        }[what]
        out.append(f"WHEN regexp_matches({uri}, '^(?:{regex})') THEN {value}")
    other = {
        "accepted": "false",
        "pattern": "NULL",
        "text": f"'The URI [' || {uri} || '] is rejected because no accept pattern accepted it'",
    }[what]
    return "CASE " + " ".join(out) + f" ELSE {other} END"


def filtered(rules: list[tuple[bool, str]]) -> str:
    return (
        f"WITH {PAGES} SELECT page_id, uri, {rule_case('uri', rules, 'accepted')} AS accepted, "
        f"{rule_case('uri', rules, 'pattern')} AS pattern FROM p"
    )


def robots_allowed(site: str, path: str) -> str:
    k = f"length({site}) % 5"
    low = f"lower({path})"
    return (
        f"CASE WHEN {k} = 0 THEN NOT (starts_with({low}, '/fr/') OR starts_with({low}, '/~private'))"
        f" WHEN {k} = 1 THEN starts_with({low}, '/en/1')"
        f" OR NOT (starts_with({low}, '/en/') OR starts_with({low}, '/de/'))"
        f" WHEN {k} = 3 THEN false ELSE true END"
    )


CONFIGS = f"""{SITES}, c AS (
  SELECT site, length(site) AS n, length(site) % 2 = 0 AS first,
    'The URI [' AS t FROM s)"""

CASES = """k AS (
  SELECT site, first, 'seed' AS kind, 0 AS pos, site AS uri, true AS want, true AS got,
    site AS pattern FROM c WHERE n % 5 > 0
  UNION ALL SELECT site, first, 'seed', 1, site || '/fr/', true, first,
    CASE WHEN first THEN site ELSE '.*/fr/' END FROM c WHERE n % 5 > 0
  UNION ALL SELECT site, first, 'test', 0, site || '/en/1', true, true, site FROM c
  UNION ALL SELECT site, first, 'test', 1, site || '/fr/1', false, first,
    CASE WHEN first THEN site ELSE '.*/fr/' END FROM c
  UNION ALL SELECT site, first, 'test', 2, 'http://elsewhere.example.org/', true, false, NULL
    FROM c),
m AS (
  SELECT *, 'The URI [' || uri || '] is ' || CASE WHEN pattern IS NULL
    THEN 'rejected because no accept pattern accepted it'
    ELSE CASE WHEN got THEN 'accepted' ELSE 'rejected' END || ' by pattern [' || pattern || ']'
    END AS text FROM k)"""

DOC = """d AS (SELECT page_id, site, site || '/doc/' AS root, page_id::VARCHAR AS i FROM p)"""

DOC_LINKS = """dl AS (
  SELECT root || 'html/' || i AS page_uri, 'a' AS element, 'x' || i || '.html' AS uri_attribute,
    'T x' AS link_text, true AS no_follow, site || '/b/x' || i || '.html' AS uri,
    NULL AS fail_message FROM d
  UNION ALL SELECT root || 'html/' || i, 'img', 'i.png', '', false, site || '/b/i.png', NULL FROM d
  UNION ALL SELECT root || 'html/' || i, 'q', 'q.html?b=1&a=2', 'one quote', false,
    site || '/b/q.html?a=2&b=1', NULL FROM d
  UNION ALL SELECT root || 'html/' || i, 'css_url', 's' || i || '.css', '', false,
    site || '/b/s' || i || '.css', NULL FROM d
  UNION ALL SELECT root || 'flagged/' || i, 'a', 'bad' || i || '.html?id===', 'bad', true, NULL,
    'base[' || root || 'flagged/' || i || '] relative[bad' || i || '.html?id===]' FROM d
  UNION ALL SELECT root || 'flagged/' || i, 'a', '../up.html', 'up', true,
    site || '/doc/up.html', NULL FROM d
  UNION ALL SELECT root || 'css/' || i, 'css_url', 'p' || i || '.png', '', false,
    root || 'css/p' || i || '.png', NULL FROM d
  UNION ALL SELECT root || 'css/' || i, 'css_url', 'q.png', '', false, root || 'css/q.png', NULL
    FROM d
  UNION ALL SELECT root || 'css/' || i, 'css_url', 'r.png?i===', '', false, NULL,
    'url(''r.png?i==='')' FROM d)"""

LOG = """l AS (
  SELECT user_id AS job_id, user_id % 10 AS crawler_id, event_id, ts, epoch_us(ts) // 1000 AS log_ms,
    'http://s' || (event_id % 7) || '.example.org/p/' || CAST(floor(value) AS BIGINT) AS uri,
    'http://s' || (event_id % 7) || '.example.org' AS site,
    CASE event_type WHEN 'signup' THEN 301 WHEN 'error' THEN 500 ELSE 200 END AS status,
    CASE event_type WHEN 'view' THEN 'text/html; charset=UTF-8' WHEN 'click' THEN 'text/css' END
      AS content_type,
    CAST(floor(value * 100) AS BIGINT) AS content_length,
    event_id % 3 AS links_extracted,
    CAST(floor(value) AS BIGINT) % 900 AS fetch_duration,
    event_type FROM events)"""

SNAPSHOTS = f"""{LOG}, j AS (
  SELECT job_id, crawler_id, event_id, ts, CAST(ts AS DATE) AS day,
    log_ms - log_ms % 86400000 AS created_ms, log_ms AS snapshot_ms,
    CASE WHEN event_type = 'purchase' THEN log_ms END AS finished_ms,
    CASE WHEN event_type = 'purchase' THEN 'Completed' ELSE 'Continuing' END AS state,
    'event ' || event_id AS message FROM l)"""

LATEST_JOBS = f"""WITH {SNAPSHOTS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY job_id
    ORDER BY (finished_ms IS NOT NULL) DESC, snapshot_ms DESC) AS rn FROM j)"""

W = "PARTITION BY job_id ORDER BY ts, event_id"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

PROGRESS = f"""g AS (
  SELECT job_id, event_id, row_number() OVER ({W}) AS pos,
    row_number() OVER ({W}) - 1 AS attempts,
    coalesce(sum((status BETWEEN 200 AND 299)::INT) OVER ({W} {BEFORE}), 0) AS succeeds,
    coalesce(sum((status NOT BETWEEN 200 AND 399)::INT) OVER ({W} {BEFORE}), 0) AS fails,
    {LOG_RULE['seeds']} + coalesce(sum(links_extracted) OVER ({W} {BEFORE}), 0)
      - (row_number() OVER ({W}) - 1) AS pending,
    {LOG_RULE['seeds']} AS seeds FROM l)"""


def stop_case(max_queue, max_fetches, max_fail) -> str:
    """Index of the outcome: 0 keep crawling, else the reason."""
    return (
        f"CASE WHEN pending = 0 THEN 1 WHEN pending >= {max_queue} THEN 2"
        f" WHEN succeeds >= {max_fetches} THEN 3"
        f" WHEN attempts > seeds AND attempts >= 5"
        f" AND fails::DOUBLE / attempts::DOUBLE >= {max_fail} THEN 4 ELSE 0 END"
    )


def outcome_text(column: str, part: int) -> str:
    whens = " ".join(f"WHEN {i + 1} THEN '{n[part]}'" for i, n in enumerate(OUTCOME_TEXTS))
    return f"CASE coalesce({column}, 1) {whens} END"


LOG_STOPS = f"""{LOG}, {PROGRESS}, x AS (
  SELECT *, {stop_case(LOG_RULE['max_queue'], LOG_RULE['max_fetches'], LOG_RULE['max_fail'])} AS o
  FROM g),
y AS (SELECT job_id, max(pos) AS last, min(CASE WHEN o > 0 THEN pos END) AS sp,
  arg_min(o, pos) FILTER (o > 0) AS so FROM x GROUP BY job_id)"""

EDGES = """e AS (
  SELECT '/region/' || n_regionkey AS page_uri, '/nation/' || n_nationkey AS uri FROM nation
  UNION ALL SELECT '/nation/' || c_nationkey, '/customer/' || c_custkey FROM customer
  UNION ALL SELECT '/nation/' || s_nationkey, '/supplier/' || s_suppkey FROM supplier
  UNION ALL SELECT '/customer/' || o_custkey, '/order/' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT '/order/' || l_orderkey, '/part/' || l_partkey FROM lineitem),
st AS (
  SELECT '/region/' || r_regionkey AS uri, 200 AS status FROM region
  UNION ALL SELECT '/nation/' || n_nationkey, 200 FROM nation
  UNION ALL SELECT '/customer/' || c_custkey, 200 FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT '/supplier/' || s_suppkey, CASE WHEN s_acctbal < 0 THEN 302 ELSE 200 END
    FROM supplier
  UNION ALL SELECT '/order/' || o_orderkey, 200 FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT '/part/' || p_partkey, 200 FROM part),
seeds AS (
  SELECT r_regionkey::BIGINT AS job_id, '/region/' || r_regionkey AS uri FROM region
  UNION ALL SELECT (n_regionkey + 4) % 5, '/nation/' || min(n_nationkey) FROM nation
    GROUP BY n_regionkey)"""


def crawl_levels(depth: int, all_ok: bool) -> str:
    """CTEs q0 .. q<depth> of the crawl, level by level, and q for all of them."""
    status = "200" if all_ok else "coalesce(st.status, 404)"
    join = "" if all_ok else "LEFT JOIN st ON st.uri = a.uri"
    out = [
        f"""q0 AS (SELECT a.job_id, a.uri, 0 AS depth, 0 AS parent_pos,
  row_number() OVER (PARTITION BY a.job_id ORDER BY a.uri) AS pos, {status} AS status
  FROM seeds a {join})"""
    ]
    for d in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT * FROM q{i}" for i in range(d))
        out.append(
            f"""b{d} AS ({before}),
f{d} AS (SELECT k.job_id, e.uri, min(k.pos) AS parent_pos FROM q{d - 1} k
  JOIN e ON e.page_uri = k.uri WHERE k.status BETWEEN 200 AND 299 GROUP BY 1, 2),
a{d} AS (SELECT f.*, (SELECT count(*) FROM b{d} b WHERE b.job_id = f.job_id) AS earlier
  FROM f{d} f ANTI JOIN b{d} b ON b.job_id = f.job_id AND b.uri = f.uri),
q{d} AS (SELECT a.job_id, a.uri, {d} AS depth, a.parent_pos,
  a.earlier + row_number() OVER (PARTITION BY a.job_id ORDER BY a.parent_pos, a.uri) AS pos,
  {status} AS status FROM a{d} a {join})"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM q{i}" for i in range(depth + 1))
    out.append(f"q AS ({every})")
    return ", ".join(out)


WQ = "PARTITION BY q.job_id ORDER BY q.pos"

MAP_PROGRESS = f"""{EDGES}, {crawl_levels(MAP_DEPTH, False)},
nl AS (SELECT job_id, parent_pos AS pos, count(*) AS n FROM q WHERE parent_pos > 0 GROUP BY 1, 2),
ns AS (SELECT job_id, count(*) AS seeds FROM q WHERE depth = 0 GROUP BY 1),
g AS (
  SELECT q.job_id, q.pos, q.depth, q.status, seeds, q.pos - 1 AS attempts,
    coalesce(sum((status BETWEEN 200 AND 299)::INT) OVER ({WQ} {BEFORE}), 0) AS succeeds,
    coalesce(sum((status NOT BETWEEN 200 AND 399)::INT) OVER ({WQ} {BEFORE}), 0) AS fails,
    seeds + coalesce(sum(coalesce(nl.n, 0)) OVER ({WQ} {BEFORE}), 0) - (q.pos - 1) AS pending
  FROM q LEFT JOIN nl ON nl.job_id = q.job_id AND nl.pos = q.pos
  JOIN ns ON ns.job_id = q.job_id)"""


def budget_select(name: str) -> str:
    return f"""SELECT job_id, CAST(coalesce(sp, last + 1) AS BIGINT) AS stop_pos,
  {outcome_text('so', 0)} AS state, {outcome_text('so', 1)} AS message, '{name}' AS budget
  FROM (SELECT job_id, max(pos) AS last, min(CASE WHEN o > 0 THEN pos END) AS sp,
    arg_min(o, pos) FILTER (o > 0) AS so
    FROM (SELECT *, {stop_case(*BUDGETS[name])} AS o FROM g) GROUP BY job_id)"""


def bytes_text(n: str) -> str:
    """Decimal unit and one digit, rounded half up in whole numbers."""
    out = f"CASE WHEN {n} < 1000 THEN {n} || ' b '"
    for i, unit in enumerate("kMGT"):
        size = 1000 ** (i + 1)
        tenths = f"(({n} * 10 + {size // 2}) // {size})"
        out += (
            f" WHEN {n} < {size * 1000} THEN ({tenths} // 10) || '.' || ({tenths} % 10)"
            f" || ' {unit}B'"
        )
    return out + " END"


def elapsed_text(ms: str) -> str:
    def part(value: str, unit: str) -> str:
        return f"CASE WHEN {value} > 0 THEN {value} || '{unit}' END"

    parts = ", ".join(
        [
            part(f"({ms} // 86400000)", "d"),
            part(f"({ms} // 3600000 % 24)", "h"),
            part(f"({ms} // 60000 % 60)", "m"),
            part(f"({ms} // 1000 % 60)", "s"),
        ]
    )
    return f"CASE WHEN {ms} < 1000 THEN {ms} || 'ms' ELSE concat_ws(' ', {parts}) END"


CANDIDATES = f"""{PAGES}, {HREFS}, {LINKS}, k AS (
  SELECT DISTINCT page_id, uri, 'http' AS scheme, site, substr(uri, length(site) + 1) AS path FROM l
  UNION ALL SELECT page_id, uri, 'http', site, path FROM p
  UNION ALL SELECT page_id, 'mailto:p' || page_id || '@example.org', 'mailto', NULL, '' FROM p
  UNION ALL SELECT page_id, 'ftp' || regexp_replace(uri, '^https?', ''), 'ftp',
    'ftp' || regexp_replace(site, '^https?', ''), path FROM p)"""

DECISION = (
    "CASE WHEN scheme <> 'http' THEN 'UnsupportedScheme'"
    f" WHEN NOT ({rule_case('uri', AS_WRITTEN, 'accepted')}) THEN 'UriFilterRejected'"
    f" WHEN NOT ({robots_allowed('site', 'path')}) THEN 'RobotsExcluded' ELSE 'OkayToFetch' END"
)

JOBS_OUT = "SELECT job_id, snapshot_ms, finished_ms, state, message FROM r WHERE rn = 1"

DAILY = f"""{SNAPSHOTS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY job_id, day ORDER BY snapshot_ms DESC, event_id DESC)
    AS rn FROM j)"""

FETCH_COUNTERS = f"""WITH {LOG} SELECT job_id, count(*) AS fetch_attempts,
  count(*) FILTER (status BETWEEN 200 AND 299) AS fetch_succeeds,
  count(*) FILTER (status NOT BETWEEN 200 AND 399) AS fetch_fails,
  count(*) FILTER (status BETWEEN 300 AND 399) AS redirects FROM l GROUP BY job_id"""

OUTCOMES = f"""WITH {LOG_STOPS} SELECT job_id, coalesce(sp, last + 1) AS stop_pos,
  {outcome_text('so', 0)} AS state, {outcome_text('so', 1)} AS message FROM y"""

DIR = "regexp_extract(path, '^.*/')"

RELATIVE = [
    ("g", f"site || {DIR} || 'g'"),
    ("./g", f"site || {DIR} || 'g'"),
    ("../g", f"site || regexp_replace({DIR}, '[^/]+/$', '') || 'g'"),
    ("g/", f"site || {DIR} || 'g/'"),
    ("/g", "site || '/g'"),
    ("//g", "scheme || '://g'"),
    ("?y", "bare || '?y'"),
    ("g?y#s", f"site || {DIR} || 'g?y'"),
    ("g;x?y", f"site || {DIR} || 'g;x?y'"),
    ("#s", "uri"),
    ("mailto:a@b", "'mailto:a@b'"),
    ("", "NULL"),
]

ORACLES: dict[str, str] = {
    "url_canonical": f"""WITH {PAGES}, {MESSY}
SELECT page_id, variant::INT AS variant, uri,
  CASE WHEN uri IS NOT NULL THEN scheme END AS scheme,
  CASE WHEN uri IS NOT NULL THEN site END AS site,
  CASE WHEN uri IS NOT NULL THEN path END AS path,
  CASE WHEN uri IS NULL THEN 'illegal URI [' || url || ']' END AS fail_message FROM v""",
    "url_duplicates": f"""WITH {PAGES}, {MESSY}
SELECT uri, count(*) AS urls, count(DISTINCT url) AS spellings, min(url) AS first_spelling
FROM v WHERE uri IS NOT NULL GROUP BY uri HAVING count(*) > 1""",
    "url_resolve": f"""WITH {PAGES}, {HREFS}
SELECT DISTINCT page_id, href, site || {ENCODED} AS uri, site FROM h""",
    "url_relative": f"WITH {PAGES} "
    + " UNION ALL ".join(
        f"SELECT page_id, '{ref}' AS ref, {uri} AS uri, "
        + ("'the URI string was missing or empty'" if ref == "" else "NULL")
        + " AS fail_message FROM p"
        for ref, uri in RELATIVE
    ),
    "filter_first_match": filtered(AS_WRITTEN),
    "filter_priority_reject": filtered(REJECTS_FIRST),
    "filter_explain": f"""WITH {PAGES} SELECT page_id, uri,
  {rule_case('uri', AS_WRITTEN, 'text')} AS first_match,
  {rule_case('uri', REJECTS_FIRST, 'text')} AS priority_reject FROM p""",
    "rule_lines": """WITH x AS (
  SELECT page_id, 0 AS pos, 'accept' AS key, url AS value, NULL AS line FROM pages
  UNION ALL SELECT page_id, 1, NULL, NULL, ' accept: ' || url FROM pages
  UNION ALL SELECT page_id, 2, NULL, NULL, 'reject :  ' || url FROM pages
  UNION ALL SELECT page_id, 3, 'reject', url, NULL FROM pages
  UNION ALL SELECT page_id, 6, NULL, NULL, 'follow: all' FROM pages)
SELECT page_id, pos, key, value, CASE WHEN line IS NOT NULL THEN
  'Unrecognised directive on line [' || line || ']. Directives should be one of [accept,reject]'
  END AS error FROM x""",
    "config_test": f"""WITH {CONFIGS}, {CASES} SELECT site AS config_id, kind, pos, uri,
  got = want AS passed, CASE WHEN got = want THEN 'passed' ELSE text END AS message FROM m""",
    "config_results": f"""WITH {CONFIGS}, {CASES} SELECT site AS config_id,
  bool_and(got = want) AS all_passed, count(*) AS cases,
  count(*) FILTER (got <> want) AS failures FROM m GROUP BY site""",
    "config_validate": f"""WITH {CONFIGS}, {CASES}, r AS (
  SELECT site, bool_and(got) AS ok, string_agg(text, ' and ' ORDER BY pos) AS texts
  FROM m WHERE kind = 'seed' GROUP BY site),
z AS (SELECT c.site, CASE WHEN n % 4 = 1 THEN '{NO_AGENT}'
  WHEN n % 5 = 0 THEN '{NO_SEEDS}'
  WHEN NOT ok THEN 'The crawler URI filter rejected the seeds: ' || texts END AS reason
  FROM c LEFT JOIN r ON r.site = c.site)
SELECT site AS config_id, reason IS NULL AS valid, reason FROM z""",
    "robots_rules": f"""WITH {SITES}, k AS (SELECT site, length(site) % 5 AS k FROM s)
SELECT site, 'trawler' AS user_agent, CASE k WHEN 1 THEN '/en/1' ELSE '' END AS allows,
  CASE k WHEN 0 THEN '/fr/|/~private' WHEN 1 THEN '/en/|/de/' ELSE '' END AS disallows,
  CASE k WHEN 1 THEN lower(site) || '/sitemap.xml' ELSE '' END AS sitemaps,
  CASE k WHEN 1 THEN 'www.example.org' ELSE '' END AS hosts,
  (k = 1)::INT AS n_allows, CASE k WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END
    AS n_disallows, (k = 1)::INT AS n_sitemaps, (k = 1)::INT AS n_hosts,
  CASE k WHEN 1 THEN 1500 END AS crawl_delay_ms FROM k WHERE k < 4""",
    "robots_allow": f"""WITH {PAGES}
SELECT page_id, uri, {robots_allowed('site', 'path')} AS allowed FROM p""",
    "robots_delay": f"""WITH {PAGES} SELECT page_id, site,
  CASE WHEN length(site) % 5 = 1 THEN greatest(1500, {ROBOTS_CONFIG_MS})
  ELSE {ROBOTS_CONFIG_MS} END AS delay_ms FROM p""",
    "robots_stale": f"""WITH {SITES} SELECT 'trawler' AS user_agent, site FROM s
WHERE length(site) % 5 = 4 OR length(site) * 1000 < {STALE_ASOF_MS}""",
    "robots_listing": f"""WITH {SITES}
SELECT site, 'trawler' AS user_agent, lower(site) || '/sitemap.xml' AS value, 'sitemap' AS kind
FROM s WHERE length(site) % 5 = 1
UNION ALL SELECT site, 'trawler', 'www.example.org', 'host' FROM s WHERE length(site) % 5 = 1""",
    "links_html": f"""WITH {PAGES}, {HREFS}, {LINKS} SELECT page_id, 'a' AS element,
  href AS uri_attribute, txt AS link_text, false AS no_follow, uri,
  CAST(NULL AS VARCHAR) AS fail_message FROM l""",
    "links_per_page": f"""WITH {PAGES}, {HREFS}, {LINKS}, n AS (
  SELECT page_id, count(*) AS n FROM l GROUP BY page_id)
SELECT p.page_id, uri, coalesce(n, 0)::INT AS links_extracted
FROM p LEFT JOIN n ON n.page_id = p.page_id""",
    "link_targets": f"""WITH {PAGES}, {HREFS}, {LINKS}
SELECT DISTINCT page_id, 1 AS depth, uri, site FROM l""",
    "page_degree": f"""WITH {PAGES}, {HREFS}, {LINKS}, t AS (
  SELECT DISTINCT page_id, page_uri, uri FROM l),
x AS (SELECT page_uri AS node, 1 AS o, 0 AS i FROM t UNION ALL SELECT uri, 0, 1 FROM t)
SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM x GROUP BY node""",
    "site_degree": f"""WITH {PAGES}, {HREFS}, {LINKS}, t AS (
  SELECT DISTINCT page_id, site, uri FROM l)
SELECT site AS node, count(*) AS out_degree, count(*) AS in_degree FROM t GROUP BY site""",
    "doc_links": f"WITH {PAGES}, {DOC}, {DOC_LINKS} SELECT * FROM dl",
    "page_flags": f"""WITH {PAGES}, {DOC}
SELECT root || kind || '/' || i AS uri, kind = 'html' AS no_index, kind = 'flagged' AS no_follow,
  CAST(NULL AS VARCHAR) AS page_error
FROM d, (SELECT unnest(['html', 'flagged', 'css', 'text']) AS kind)""",
    "broken_links": f"""WITH {PAGES}, {DOC}, {DOC_LINKS}
SELECT page_uri, fail_message FROM dl WHERE fail_message IS NOT NULL""",
    "response_fields": f"""WITH x AS (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text/html; charset=UTF-8' WHEN 1 THEN 'text/css'
    WHEN 2 THEN 'TEXT/HTML' END AS content_type, strlen(html) AS bytes, length(html) AS chars,
    200 + page_id % 5 * 100 AS code FROM pages),
y AS (SELECT *, CASE WHEN bytes > {MAX_BYTES} THEN -1 ELSE code END AS status FROM x)
SELECT page_id, content_type, coalesce(starts_with(content_type, 'text/html'), false) AS is_html,
  coalesce(starts_with(content_type, 'text/css'), false) AS is_css,
  coalesce(starts_with(content_type, 'text'), false) AS is_text,
  bytes AS content_length, chars AS characters, status,
  CASE WHEN status BETWEEN 200 AND 299 THEN 'success'
    WHEN status BETWEEN 300 AND 399 THEN 'redirect' ELSE 'fail' END AS status_class FROM y""",
    "document_tables": f"""WITH {PAGES} SELECT 'job-' || (page_id % 7) AS job_id, uri,
  CASE WHEN page_id % 3 > 0 THEN 'text/html' ELSE 'undefined' END AS content_type,
  (page_id % 4)::INT AS depth, '200' AS response_status, page_id * 1000 AS fetched_ms,
  strlen(html) AS content_length, strlen(html) AS stored_bytes FROM p""",
    "document_read": f"""WITH {PAGES}, d AS (SELECT 'job-' || (page_id % 7) AS job_id, uri,
  CASE WHEN page_id % 3 > 0 THEN 'text/html' ELSE 'undefined' END AS content_type,
  strlen(html) AS stored_bytes FROM p),
k AS (SELECT job_id, min(uri) AS uri FROM d WHERE contains(uri, '?') GROUP BY job_id)
SELECT job_id, uri, content_type, stored_bytes FROM d JOIN k USING (job_id, uri)""",
    "metadata_read": f"""WITH {PAGES} SELECT 'job-3' AS job_id, uri, (page_id % 4)::INT AS depth,
  page_id * 1000 AS fetched_ms, '200' AS response_status FROM p WHERE page_id % 7 = 3""",
    "log_read": f"""WITH {LOG} SELECT job_id, event_id, log_ms, uri, status FROM l
WHERE job_id = (SELECT max_by(job_id, event_id) FROM l)""",
    "jobs_of_crawler": f"""WITH {DAILY} SELECT job_id, created_ms, snapshot_ms, state, message
FROM r WHERE rn = 1 AND crawler_id = 3""",
    "jobs_json": f"""WITH {DAILY} SELECT '{{"jobId":' || job_id || ',"crawlerId":' || crawler_id
  || ',"createdDate":"' || strftime(make_timestamp(created_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g')
  || '+0000","snapshotDate":"'
  || strftime(make_timestamp((snapshot_ms + event_id % 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || '+0000"'
  || coalesce(',"finishedDate":"' || strftime(make_timestamp(finished_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || '+0000"', '')
  || ',"state":"' || state || '","message":"' || message || '"}}' AS json FROM r WHERE rn = 1""",
    "metadata_json": f"""WITH {PAGES} SELECT '{{"crawlerId":"crawler","jobId":"job-' || (page_id % 7)
  || '","uri":"' || uri || '","contentType":"' || CASE WHEN page_id % 3 > 0 THEN 'text/html' ELSE 'undefined' END
  || '","contentLength":' || strlen(html) || ',"depth":' || (page_id % 4) || ',"fetched":"'
  || strftime(make_timestamp(page_id * 1000000), '%Y-%m-%dT%H:%M:%S.%g') || '+0000","responseStatus":"200"}}' AS json FROM p""",
    "jobs_tables": f"""WITH {DAILY}
SELECT 'day' AS layout, day::VARCHAR AS key, count(*) AS n, max(snapshot_ms) AS newest_ms
FROM r WHERE rn = 1 GROUP BY day
UNION ALL SELECT 'crawler', crawler_id::VARCHAR, count(*), max(snapshot_ms)
FROM r WHERE rn = 1 GROUP BY crawler_id""",
    "frontier_decisions": f"""WITH {CANDIDATES} SELECT page_id, uri,
  CASE WHEN uri IN (SELECT uri FROM p WHERE contains(uri, '?')) THEN 'SeenAlready'
  ELSE {DECISION} END AS decision FROM k""",
    "decision_counts": f"""WITH {CANDIDATES}, x AS (SELECT site, {DECISION} AS decision FROM k)
SELECT site, decision, count(*) AS n FROM x GROUP BY site, decision""",
    "unseen_links": f"""WITH {PAGES}, {HREFS}, {LINKS}
SELECT DISTINCT site AS job_id, uri FROM l
EXCEPT SELECT site, uri FROM l WHERE contains(page_uri, '?')""",
    "crawl_seeds": f"""WITH {SITES} SELECT site AS config_id, site || x AS uri, 0 AS depth
FROM s, (SELECT unnest(['', '/fr/']) AS x) WHERE length(site) % 5 > 0""",
    "crawl_levels": f"""WITH {EDGES}, {crawl_levels(LEVEL_DEPTH, True)}
SELECT job_id, uri, depth FROM q""",
    "crawl_positions": f"""WITH {EDGES}, {crawl_levels(MAP_DEPTH, False)}
SELECT job_id, uri, depth, parent_pos::BIGINT AS parent_pos, pos::BIGINT AS pos, status FROM q""",
    "crawl_budget": f"WITH {MAP_PROGRESS} "
    + " UNION ALL ".join(budget_select(name) for name in BUDGETS),
    "crawl_fetched": f"""WITH {MAP_PROGRESS}, x AS (
  SELECT *, min(CASE WHEN {stop_case(*BUDGETS['fetches'])} > 0 THEN pos END)
    OVER (PARTITION BY job_id) AS sp FROM g)
SELECT job_id, CASE WHEN status BETWEEN 200 AND 299 THEN 'success'
  WHEN status BETWEEN 300 AND 399 THEN 'redirect' ELSE 'fail' END AS result,
  count(*) AS fetches, max(depth) AS max_depth FROM x WHERE sp IS NULL OR pos < sp
GROUP BY 1, 2""",
    "crawl_chain": f"""WITH {PAGES}, r AS (
  SELECT site, page_id, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS d FROM p)
SELECT site AS job_id, site || '/page/' || page_id AS uri, d::INT AS depth FROM r""",
    "fetch_counters": FETCH_COUNTERS,
    "response_counters": f"""WITH {LOG}
SELECT job_id, status::VARCHAR AS status_code, count(*) AS responses FROM l GROUP BY 1, 2""",
    "media_counters": f"""WITH {LOG}
SELECT job_id, coalesce(content_type, 'undefined') AS media_type, count(*) AS documents,
  sum(content_length)::BIGINT AS total_bytes FROM l WHERE status BETWEEN 200 AND 299
GROUP BY 1, 2""",
    "counter_entries": f"""WITH {LOG}
SELECT job_id, 'fetch' AS kind, 'FetchAttempts' AS name, count(*) AS value FROM l GROUP BY job_id
UNION ALL SELECT job_id, 'fetch', CASE WHEN status BETWEEN 200 AND 299 THEN 'FetchSucceeds'
  WHEN status BETWEEN 300 AND 399 THEN 'Redirects' ELSE 'FetchFails' END, count(*) FROM l
  GROUP BY 1, 3
UNION ALL SELECT job_id, 'response', status::VARCHAR, count(*) FROM l GROUP BY 1, 3
UNION ALL SELECT job_id, 'bytes', coalesce(content_type, 'undefined'),
  sum(content_length)::BIGINT FROM l WHERE status BETWEEN 200 AND 299 GROUP BY 1, 3""",
    "job_summary": f"""WITH {LOG}, x AS (
  SELECT job_id, max(log_ms) - min(log_ms) AS duration_ms,
    count(*) FILTER (status BETWEEN 200 AND 299) AS files,
    coalesce(sum(content_length) FILTER (status BETWEEN 200 AND 299), 0)::BIGINT AS total_bytes,
    count(*) FILTER (status BETWEEN 300 AND 399) AS redirects,
    count(*) FILTER (status NOT BETWEEN 200 AND 399) AS fails FROM l GROUP BY job_id),
y AS (SELECT *, duration_ms // greatest(files, 1) AS avg_fetch_ms FROM x)
SELECT *, {elapsed_text('duration_ms')} AS duration_text,
  {elapsed_text('avg_fetch_ms')} AS avg_fetch_text, {bytes_text('total_bytes')} AS bytes_text
FROM y""",
    "uris_seen": f"""WITH {LOG}
SELECT job_id, count(DISTINCT uri) AS uris_seen FROM l GROUP BY job_id""",
    "fetch_log_running": f"""WITH {LOG}, x AS (
  SELECT job_id, event_id, row_number() OVER ({W}) AS pos,
    sum((status BETWEEN 200 AND 299)::INT) OVER ({W})::BIGINT AS fetches,
    (1 + coalesce(sum(links_extracted) OVER ({W} {BEFORE}), 0))::BIGINT AS uris_seen FROM l)
SELECT *, uris_seen - pos AS uris_queued FROM x""",
    "stop_point": f"WITH {LOG_STOPS} SELECT job_id, sp AS stop_pos FROM y WHERE sp IS NOT NULL",
    "job_outcome": OUTCOMES,
    "job_timeout": f"""WITH {LOG}, x AS (
  SELECT job_id, row_number() OVER ({W}) AS pos, log_ms, min(log_ms) OVER (PARTITION BY job_id) AS m
  FROM l),
y AS (SELECT job_id, max(pos) AS last, min(CASE WHEN log_ms > m + {LOG_TIMEOUT_MS} THEN pos END)
  AS sp FROM x GROUP BY job_id)
SELECT job_id, coalesce(sp, last + 1) AS stop_pos,
  CASE WHEN sp IS NULL THEN 'Completed' ELSE 'Aborted' END AS state,
  CASE WHEN sp IS NULL THEN 'Completed Okay' ELSE 'Crawl exceeded maximum crawl time' END AS message FROM y""",
    "politeness_schedule": f"""WITH {LOG}, x AS (
  SELECT *, greatest(event_id % 7 * 100, 250) AS delay_ms FROM l)
SELECT job_id, event_id, delay_ms, (sum(delay_ms) OVER ({W})
  + coalesce(sum(fetch_duration) OVER ({W} {BEFORE}), 0))::BIGINT AS planned_ms FROM x""",
    "politeness_gap": f"""WITH {LOG}, x AS (
  SELECT job_id, site, event_id, greatest(event_id % 7 * 100, 250) * 1000000 AS delay_ms,
    log_ms - lag(log_ms) OVER (PARTITION BY job_id, site ORDER BY ts, event_id) AS gap_ms FROM l)
SELECT job_id, site, event_id, gap_ms, coalesce(gap_ms < delay_ms, false) AS too_soon FROM x""",
    "jobs_latest": f"""{LATEST_JOBS}
SELECT job_id, crawler_id, snapshot_ms, finished_ms, state, message FROM r WHERE rn = 1""",
    "jobs_by_day": f"""WITH {DAILY} SELECT job_id, created_ms, snapshot_ms, state, message
FROM r WHERE rn = 1 AND day = DATE '{DAY}'""",
    "log_latest": f"""WITH {LOG}, r AS (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn FROM l)
SELECT job_id, event_id, log_ms, uri, status FROM r WHERE rn = 1""",
    "retention": f"""WITH {LOG}
SELECT job_id, event_id, log_ms FROM l WHERE log_ms >= {RETENTION_ASOF_MS} - 7 * 86400000""",
    "upsert_jobs": f"""WITH {SNAPSHOTS}, r AS (
  SELECT *, snapshot_ms >= {MID_MONTH_MS} AS later FROM j
  WHERE snapshot_ms < {MID_MONTH_MS} OR state = 'Completed'),
k AS (SELECT *, row_number() OVER (PARTITION BY job_id, later
  ORDER BY snapshot_ms DESC, event_id DESC) AS rn FROM r),
n AS (SELECT * FROM k WHERE rn = 1 AND later)
SELECT job_id, snapshot_ms, event_id, state, message FROM n
UNION ALL SELECT job_id, snapshot_ms, event_id, state, message FROM k
WHERE rn = 1 AND NOT later AND job_id NOT IN (SELECT job_id FROM n)""",
    "config_json": f"""WITH {CONFIGS} SELECT site AS crawler_id,
  CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'bot' END AS user_agent,
  CASE WHEN n % 5 = 0 THEN '' ELSE site || '|' || site || '/fr/' END AS seeds,
  CASE WHEN first THEN 'FirstMatchUriFilter' ELSE 'PriorityRejectUriFilter' END AS filter_class,
  'accept: ' || site || '|# a comment|reject: .*/fr/|' AS rule_lines,
  'Crawl of ' || upper(site) AS crawler_name, n * 10 AS crawl_delay_ms,
  60000::BIGINT AS crawl_timeout_ms, n * 2 AS max_fetches, 0.5::DOUBLE AS max_request_fails
FROM c""",
    "config_list": f"""WITH {SITES}
SELECT site AS crawler_id, 'Crawl of ' || upper(site) AS crawler_name FROM s""",
    "config_delete": f"WITH {SITES} SELECT site AS crawler_id FROM s WHERE NOT ends_with(site, '.org')",
    "job_configs": f"""WITH {PAGES} SELECT page_id, site AS crawler_id,
  'Crawl of ' || upper(site) AS crawler_name, length(site) * 2 AS max_fetches FROM p""",
    "export_json": f"""WITH {LOG} SELECT '{{"id":' || event_id || ',"jobId":' || job_id
  || ',"logTime":"' || strftime(ts + to_milliseconds(event_id % 1000), '%Y-%m-%dT%H:%M:%S.%g') || '+0000","uri":"'
  || uri || '","statusCode":' || status
  || coalesce(',"contentType":"' || content_type || '"', '') || '}}' AS json FROM l""",
    "journal_log": f"""WITH {LOG} SELECT job_id, event_id, uri, status::BIGINT AS status, log_ms
FROM l WHERE event_type NOT IN ('purchase', 'signup')""",
    "journal_jobs": f"{LATEST_JOBS} {JOBS_OUT}",
    "journal_documents": f"""WITH {LOG} SELECT DISTINCT job_id, uri, 'body of ' || uri AS text
FROM l WHERE event_type NOT IN ('purchase', 'signup')""",
    "counters_stream": FETCH_COUNTERS,
    "job_states_stream": f"{LATEST_JOBS} {JOBS_OUT}",
    "seen_stream": f"WITH {LOG} SELECT DISTINCT job_id, uri FROM l",
    "decided_stream": f"""WITH {PAGES}, k AS (SELECT page_id, uri, 'http' AS scheme, site, path FROM p)
SELECT page_id, uri, {DECISION} AS decision FROM k""",
    "outcome_stream": OUTCOMES.replace("FROM y", "FROM y WHERE sp IS NOT NULL").replace(
        "coalesce(sp, last + 1)", "sp"
    ),
    "element_text": f"""WITH {PAGES}, a AS (
  SELECT page_id, site, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'),
    '(?s)<[a-zA-Z/!][^>]*$', '') AS t FROM p),
b AS (SELECT page_id, site, regexp_replace(regexp_replace(t,
    '(?i)</?(address|article|aside|blockquote|br|div|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)(\\s[^>]*)?>', ' ', 'g'),
    '<[a-zA-Z/!][^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, site, regexp_replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'),
    '&amp;|&amp([^a-zA-Z0-9=]|$)', '&\\1', 'g') AS t FROM b)
SELECT page_id, site || '/all' AS uri, trim(regexp_replace(t, '[ \\t\\n\\f\\r]+', ' ', 'g')) AS link_text FROM c""",
    "listed_links": f"""WITH {PAGES} SELECT page_id, 'line' AS element, '/x/' || page_id AS uri_attribute, site || '/x/' || page_id AS uri
FROM p WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, 'line', bare, bare FROM p WHERE page_id % 3 <> 0""",
    "ended_stream": f"""WITH {LOG}, g AS (
  SELECT job_id, log_ms, row_number() OVER w AS pos, min(log_ms) OVER w + 864000000 AS deadline,
    coalesce(sum((status BETWEEN 200 AND 299)::INT) OVER b, 0) AS ok, coalesce(sum((status NOT BETWEEN 200 AND 399)::INT) OVER b, 0) AS bad,
    20 + coalesce(sum(links_extracted) OVER b, 0) - (row_number() OVER w - 1) AS pending
  FROM l WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id),
    b AS (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT job_id, count(*) AS n, min(log_ms) + 864000000 AS deadline, count(*) FILTER (status BETWEEN 200 AND 299) AS ok,
    count(*) FILTER (status NOT BETWEEN 200 AND 399) AS bad, 20 + sum(links_extracted) - count(*) AS pending FROM l GROUP BY job_id),
a AS (SELECT job_id, pos, ok, bad, pending, log_ms > deadline AS late FROM g
  UNION ALL SELECT job_id, n + 1, ok, bad, pending, true FROM t WHERE deadline < (SELECT max(log_ms) FROM l)),
r AS (SELECT job_id, pos, CASE WHEN pending = 0 THEN 'Completed: Completed Okay' WHEN pending >= 30 THEN 'Aborted: Too many URIs queued for crawling'
    WHEN ok >= 40 THEN 'Aborted: Crawl exceeded maximum fetch requests' WHEN late THEN 'Aborted: Crawl exceeded maximum crawl time'
    WHEN pos - 1 > 20 AND bad >= 0.5 * (pos - 1) THEN 'Aborted: Too many failed fetches' END AS said FROM a)
SELECT 'job-' || job_id AS job_id, min(pos) AS stop_pos, split_part(arg_min(said, pos), ': ', 1) AS state, split_part(arg_min(said, pos), ': ', 2) AS message
FROM r WHERE said IS NOT NULL GROUP BY job_id""",
    "robots_from_files": f"""WITH {PAGES}
SELECT page_id, uri, {robots_allowed('site', 'path')} AS allowed FROM p""",
    "retention_days": f"""WITH {LOG} SELECT job_id, event_id, log_ms FROM l WHERE log_ms >= 1706659200000 - 7 * 86400000""",
    "config_upsert": f"""WITH {SITES} SELECT site AS crawler_id,
  CASE WHEN starts_with(site, 'https:') THEN 'Again Crawl of ' ELSE 'Crawl of ' END || upper(site) AS crawler_name
FROM s WHERE NOT ends_with(site, '.org')""",
    "document_upsert": f"""WITH {PAGES}, d AS (
  SELECT 'job-' || (page_id % 7) AS job_id, uri, page_id, 1 AS version, strlen(html) AS n FROM p
  UNION ALL SELECT 'job-' || (page_id % 7), uri, page_id, 2, strlen(html) + 5 FROM p WHERE page_id % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id, uri ORDER BY version DESC, page_id DESC) AS rn FROM d)
SELECT job_id, uri, page_id, version, n AS stored_bytes FROM r WHERE rn = 1 AND NOT contains(uri, '?')""",
    "job_breakdown": f"""WITH {LOG}, x AS (
  SELECT job_id, 'type' AS kind, coalesce(content_type, 'undefined') AS name, count(*) AS "count", sum(content_length)::BIGINT AS total_bytes
  FROM l WHERE status BETWEEN 200 AND 299 GROUP BY ALL
  UNION ALL SELECT job_id, 'code', 'HTTP ' || status, count(*), NULL FROM l GROUP BY job_id, status)
SELECT *, (row_number() OVER (PARTITION BY job_id, kind ORDER BY name))::INT AS place,
  CASE WHEN total_bytes IS NOT NULL THEN {bytes_text('total_bytes')} END AS bytes_text FROM x""",
    "job_uris": f"""WITH {LOG} SELECT job_id, 20 + sum(links_extracted)::BIGINT AS uris_seen,
  20 + sum(links_extracted)::BIGINT - count(*) AS uris_queued FROM l GROUP BY job_id""",
    "uris_sketched": f"""WITH {LOG} SELECT job_id, count(DISTINCT uri) AS uris_seen, true AS "close" FROM l GROUP BY job_id""",
    "jobs_by_key": f"""WITH {SNAPSHOTS}, a AS (SELECT crawler_id, job_id, snapshot_ms >= 1705363200000 AS later,
    arg_max(struct_pack(snapshot_ms := snapshot_ms, event_id := event_id, state := state, message := message), (snapshot_ms, event_id)) AS r FROM j GROUP BY ALL),
b AS (SELECT crawler_id, job_id, arg_max(r, later) AS r FROM a GROUP BY ALL)
SELECT crawler_id, job_id, r.snapshot_ms, r.event_id, r.state, r.message FROM b
WHERE job_id IN (SELECT job_id FROM j WHERE state = 'Completed')""",
    "seen_stream_bounded": f"WITH {LOG} SELECT DISTINCT job_id, uri FROM l",
}
