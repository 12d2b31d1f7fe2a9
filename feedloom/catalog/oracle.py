"""For each query the same result in plain SQL over the same tables, for checking with another engine.

Written from the rules, not from the Spark plans: windows where those use blocks, regular expressions
where those walk the page tree.
"""

from __future__ import annotations

WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def decode(x: str) -> str:
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    return x


def inline_text(x: str) -> str:
    """Text of a paragraph as written by ``inner_text``."""
    x = rf"regexp_replace({x}, '[ \t\n\r\f]+', ' ', 'g')"
    x = f"regexp_replace({x}, ' ?<br> ?', chr(10), 'g')"
    x = decode(f"regexp_replace({x}, '<[^>]*>', '', 'g')")
    return f"rtrim(ltrim({x}, ' '), ' ')"


LINKS = f"""links AS (
  SELECT page_id, url, i AS pos, len(texts) AS n, {decode("texts[i]")} AS texto, {decode("hrefs[i]")} AS href
  FROM (SELECT page_id, url,
               regexp_extract_all(html, '<li><a href="([^"]*)">(.*?)</a></li>', 2, 's') AS texts,
               regexp_extract_all(html, '<li><a href="([^"]*)">(.*?)</a></li>', 1, 's') AS hrefs
        FROM pages) p, unnest(generate_series(1, len(texts))) AS u(i))"""

RAW_LINKS = LINKS.replace(decode("texts[i]"), "texts[i]")

PARAS = f"""pieces AS (SELECT page_id, url, string_split(html, '<p>') AS parts FROM pages),
paras AS (
  SELECT page_id, url, i AS pos, len(parts) - 1 AS n, raw, contains(raw, '<b>') AS bold,
         {inline_text("raw")} AS inner_text
  FROM (SELECT page_id, url, parts, i, split_part(split_part(parts[i + 1], '</p>', 1), '</article>', 1) AS raw
        FROM pieces, unnest(generate_series(1, len(parts) - 1)) AS u(i)) x)"""

HEADINGS = f"""headings AS (
  SELECT page_id, {inline_text("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS h1 FROM pages)"""

CONV = """conv AS (SELECT conv_id AS target, turn + 1 AS pos, text AS texto, role AS usuario FROM conversations)"""

DOCS = r"""docs AS (
  SELECT lang AS target, source AS candidate, CAST(regexp_extract(source, '(\d+)', 1) AS INT) AS priority,
         doc_id AS pos, text AS texto FROM documents)"""

SCROLLS = """scrolls AS (
  SELECT user_id AS target, CAST(floor(p / 5.0) AS BIGINT) AS scroll, p % 5 + 1 AS pos,
         event_type || ':' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS texto, event_type AS usuario
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p FROM events) e)"""


def sighted(keys: str, record: str, source: str) -> str:
    return f"""sighted AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, {record} ORDER BY scroll, pos) AS nth
                 FROM {source}) s WHERE nth = 1)"""


def stop_rule(keys: str, least: str, most: str, last: str, spine: str, limits: str = "") -> str:
    """The stop rule in set form; ``limits`` are extra columns to carry."""
    extra = f", {limits}" if limits else ""
    return f"""spine AS ({spine}),
counts AS (
  SELECT sp.{keys}, sp.scroll{"".join(f", sp.{c.strip()}" for c in limits.split(",") if c.strip())},
         (SELECT count(*) FROM sighted s WHERE s.{keys} = sp.{keys} AND s.scroll = sp.scroll) AS new
  FROM spine sp),
cums AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY scroll) AS cum FROM counts),
stops AS (
  SELECT {keys}{extra}, coalesce(min(scroll) FILTER (WHERE (scroll > 0 AND cum >= {least}) OR cum >= {most}
         OR scroll + 1 >= {last}), max(scroll)) AS stop
  FROM cums GROUP BY {keys}{extra})"""


STOPPED = f"""{SCROLLS}, {sighted("target", "texto", "scrolls")},
{stop_rule("target", "10", "30", "10", "SELECT DISTINCT target, scroll FROM scrolls")}
SELECT s.target, s.texto, s.scroll, s.pos,
       row_number() OVER (PARTITION BY s.target ORDER BY s.scroll, s.pos) AS numero
FROM sighted s JOIN stops t ON s.target = t.target WHERE s.scroll <= t.stop"""

HOLES = f"""{SCROLLS}, come AS (SELECT * FROM scrolls WHERE (target + 3 * scroll) % 7 <> 5), {sighted("target", "texto", "come")},
{stop_rule("target", "least", "most", "scrolls", """SELECT target, CAST(i AS BIGINT) AS scroll, target % 12 AS least, 5 + target % 30 AS most, 2 + target % 9 AS scrolls
FROM (SELECT target, max(scroll) AS m FROM scrolls GROUP BY target) x, unnest(generate_series(0, m)) AS u(i)""", "least, most, scrolls")}
SELECT s.target, s.texto, s.scroll, s.pos,
       row_number() OVER (PARTITION BY s.target ORDER BY s.scroll, s.pos) AS numero
FROM sighted s JOIN stops t ON s.target = t.target WHERE s.scroll <= t.stop"""

DISTINCT = f"""WITH {SCROLLS}, {sighted("target", "texto, usuario", "scrolls")}
SELECT target, texto, usuario, CAST(NULL AS VARCHAR) AS "timestamp", scroll, pos FROM sighted"""

# The ordered addresses of hashtag and profile pages.
HASHTAG_TEMPLATES_A = [
    "https://twitter.com/search?q=%23{}&src=typed_query&f=top",
    "https://twitter.com/hashtag/{}?src=hashtag_click",
    "https://x.com/search?q=%23{}&src=typed_query&f=top",
    "https://x.com/hashtag/{}?src=hashtag_click",
]
HASHTAG_TEMPLATES_B = [HASHTAG_TEMPLATES_A[i] for i in (0, 2, 1, 3)]
USER_TEMPLATES_B = [
    "https://twitter.com/{}",
    "https://x.com/{}",
    "https://twitter.com/search?q=from%3A{}&src=typed_query&f=live",
]


def _urls() -> str:
    lists = [
        ("hashtag", "a", HASHTAG_TEMPLATES_A),
        ("hashtag", "b", HASHTAG_TEMPLATES_B),
        ("user", "a", USER_TEMPLATES_B[:1]),
        ("user", "b", USER_TEMPLATES_B),
    ]
    rows = ", ".join(
        f"('{kind}', '{engine}', {i}, '{tpl}')"
        for kind, engine, templates in lists
        for i, tpl in enumerate(templates, 1)
    )
    return f"""SELECT source, kind, engine, CAST(i AS BIGINT) AS priority, replace(tpl, '{{}}', source) AS url
FROM (SELECT DISTINCT source FROM documents) d, (VALUES {rows}) AS t(kind, engine, i, tpl)"""


GRID = """grid(i, most, least) AS (
  VALUES (0, 30, 10), (1, 5, 3), (2, 0, 10), (3, -1, 1), (4, 4, 0), (5, NULL, NULL))"""

BOOK = """filed AS (
  SELECT page_id, url, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS clean FROM pages)"""


def reqs(plus: int = 0) -> str:
    return f"""reqs AS (
  SELECT clean, (ascii(clean) * 256 + ascii(substring(clean, 2, 1))) * 100 + i + {plus} AS req_id,
         coalesce(most, 30) AS most, coalesce(least, 10) AS least
  FROM (SELECT DISTINCT clean FROM filed) f, grid)"""


def _page_job(cards: str, fields: str, keep: str, engine: str, plus: int = 0, blocked: bool = True) -> str:
    """CTEs of a page job over a card relation (page_id, pos, n, …), ending in ``picked``."""
    skip = " AND NOT contains(f.url, 'spam-farm')" if blocked else ""
    passes = (
        "rn <= greatest(least, 1)" if engine == "a" else "((least > 0 AND rn <= least) OR (least <= 0 AND pos = 1))"
    )
    return f"""{GRID}, {BOOK}, {reqs(plus)},
seen AS (
  SELECT r.req_id, r.clean, r.least, f.page_id AS priority, c.*
  FROM reqs r JOIN filed f ON r.clean = f.clean JOIN {cards} c ON c.page_id = f.page_id
  WHERE NOT contains(f.url, '://m.'){skip}
    AND c.pos <= CASE WHEN r.most >= 0 THEN r.most ELSE greatest(c.n + r.most, 0) END),
kept AS (SELECT *, row_number() OVER (PARTITION BY req_id, priority ORDER BY pos) AS rn FROM seen WHERE {keep}),
stopped AS (SELECT * FROM kept WHERE {passes}),
picked AS (
  SELECT CAST(req_id AS BIGINT) AS req_id, {fields}, pos AS numero
  FROM (SELECT *, min(priority) OVER (PARTITION BY req_id) AS best FROM stopped) b WHERE priority = best)"""


LINK_FIELDS = "texto, 'Unknown' AS usuario, href AS \"timestamp\""
LINK_KEEP_A = f"{strip('texto')} <> '' AND contains(lower(texto), lower(clean))"
LINK_KEEP_B = f"{strip('texto')} <> ''"
BOLD_FIELDS = f"{strip('inner_text')} AS texto, {strip('inner_text')} AS usuario, CAST(NULL AS VARCHAR) AS \"timestamp\""
BOLD_KEEP = "bold AND contains(raw, '<br>')"

JOB_HASHTAG_A = _page_job("links", LINK_FIELDS, LINK_KEEP_A, "a")
JOB_HASHTAG_B = _page_job("links", LINK_FIELDS, LINK_KEEP_B, "b", 10_000_000)
JOB_USER_A = _page_job("paras", BOLD_FIELDS, BOLD_KEEP, "a", 20_000_000, blocked=False)

POST = 'req_id, texto, usuario, "timestamp", numero'

HOSTS = """hosted AS (
  SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
         CASE WHEN contains(url, '?') THEN 1 WHEN contains(url, '#') THEN 2 ELSE 3 END AS priority FROM pages),
landing AS (
  SELECT host, priority, url, page_id FROM (
    SELECT *, row_number() OVER (PARTITION BY host, priority ORDER BY page_id) AS nth FROM hosted) x WHERE nth = 1),
unblocked AS (
  SELECT host, coalesce(min(priority) FILTER (WHERE NOT (contains(url, 'ref=') OR contains(url, '#top'))), max(priority)) AS priority
  FROM landing GROUP BY host)"""

JOB_USER_B = f"""WITH {LINKS}, {HOSTS},
profile AS (SELECT host, min(page_id) AS req_id FROM hosted GROUP BY host),
captures AS (
  SELECT p.req_id, h.page_id, row_number() OVER (PARTITION BY h.host ORDER BY h.page_id) - 1 AS scroll
  FROM hosted h JOIN unblocked u ON h.host = u.host AND h.priority = u.priority JOIN profile p ON p.host = h.host),
live AS (SELECT * FROM captures WHERE scroll < 5),
rows_ AS (
  SELECT l.req_id, l.scroll, k.pos, {strip("k.texto")} AS texto, k.href
  FROM live l JOIN links k ON k.page_id = l.page_id WHERE {strip("k.texto")} <> ''),
{sighted("req_id", "texto, href", "rows_")},
{stop_rule("req_id", "12", "20", "5", "SELECT req_id, scroll FROM live")}
SELECT s.req_id, s.texto, 'Unknown' AS usuario, s.href AS "timestamp",
       row_number() OVER (PARTITION BY s.req_id ORDER BY s.scroll, s.pos) AS numero
FROM sighted s JOIN stops t ON s.req_id = t.req_id WHERE s.scroll <= t.stop"""

# Profiles whose addresses were captured once: the first page that is no sign-in page, its distinct posts.
ONE_SCROLL = f"""{GRID}, {BOOK}, {reqs(30_000_000)},
usable AS (
  SELECT clean, page_id FROM (
    SELECT *, coalesce(min(page_id) FILTER (WHERE NOT contains(url, 'spam-farm')) OVER (PARTITION BY clean),
                       max(page_id) OVER (PARTITION BY clean)) AS best FROM filed) x
  WHERE page_id = best AND NOT contains(url, '://m.')),
shown AS (
  SELECT r.req_id, {strip("k.texto")} AS texto, k.href, min(k.pos) AS pos
  FROM reqs r JOIN usable u ON r.clean = u.clean JOIN links k ON k.page_id = u.page_id
  WHERE r.most > 0 AND {strip("k.texto")} <> '' GROUP BY ALL),
picked AS (
  SELECT CAST(req_id AS BIGINT) AS req_id, texto, 'Unknown' AS usuario, href AS "timestamp",
         row_number() OVER (PARTITION BY req_id ORDER BY pos) AS numero FROM shown)"""

BATCH = f"""got AS (
  SELECT {POST} FROM (WITH {LINKS}, {JOB_HASHTAG_A} SELECT * FROM picked) a UNION ALL
  SELECT {POST} FROM (WITH {LINKS}, {JOB_HASHTAG_B} SELECT * FROM picked) b UNION ALL
  SELECT {POST} FROM (WITH {PARAS}, {JOB_USER_A} SELECT * FROM picked) c UNION ALL
  SELECT {POST} FROM (WITH {LINKS}, {ONE_SCROLL} SELECT * FROM picked) d)"""

# Requests by address template: pages as scrolls of their language's addresses, limits from a grid.
SCROLL_GRID = """grid(i, most, least, last) AS (
  VALUES (0, 30, 10, NULL), (1, 5, 3, 0), (2, 12, 4, 2), (3, -1, 1, 7), (4, 4, 0, 1), (5, NULL, NULL, NULL), (6, 200, 90, 40))"""


def scrolled(addresses: int, scrolls: int, plus: int = 0) -> str:
    """CTEs ``caps``, pages filed under one of so many addresses, and ``reqs``, with the engine's own number of scrolls."""
    return f"""{SCROLL_GRID}, {BOOK},
caps AS (
  SELECT page_id, url, clean, n % {addresses} AS address, n // {addresses} AS scroll
  FROM (SELECT *, row_number() OVER (PARTITION BY clean ORDER BY page_id) - 1 AS n FROM filed) f),
reqs AS (
  SELECT clean, (ascii(clean) * 256 + ascii(substring(clean, 2, 1))) * 100 + i + {plus} AS req_id,
         coalesce(most, 30) AS most, coalesce(least, 10) AS least, coalesce(last, {scrolls}) AS last
  FROM (SELECT DISTINCT clean FROM filed) f, grid)"""


def _template_job(order: list[int], scrolls: int, addresses: int, keep: str, engine: str, handle: str, plus: int = 0) -> str:
    """A page job over the last capture that a request's scrolls allow; ``order``: the priority of each address."""
    rank = " ".join(f"WHEN {a} THEN {p}" for a, p in enumerate(order))
    passes = "rn <= greatest(least, 1)" if engine == "a" else "((least > 0 AND rn <= least) OR (least <= 0 AND pos = 1))"
    return f"""{scrolled(addresses, scrolls, plus)},
tried AS (
  SELECT r.*, CASE c.address {rank} END AS priority, max_by(c.page_id, c.scroll) AS page_id
  FROM reqs r JOIN caps c ON r.clean = c.clean
  WHERE NOT contains(c.url, '://m.') AND NOT contains(c.url, 'login') AND c.scroll <= greatest(r.last, 0) AND c.address < {len(order)} GROUP BY ALL),
seen AS (
  SELECT t.req_id, t.clean, t.least, t.priority, l.pos, l.texto, l.href FROM tried t JOIN links l ON l.page_id = t.page_id
  WHERE l.pos <= CASE WHEN t.most >= 0 THEN t.most ELSE greatest(l.n + t.most, 0) END),
kept AS (SELECT *, row_number() OVER (PARTITION BY req_id, priority ORDER BY pos) AS rn FROM seen WHERE {keep}),
stopped AS (SELECT * FROM kept WHERE {passes}),
picked AS (
  SELECT CAST(req_id AS BIGINT) AS req_id, {strip("texto")} AS texto, '{handle}' AS usuario, href AS "timestamp", pos AS numero
  FROM (SELECT *, min(priority) OVER (PARTITION BY req_id) AS best FROM stopped) b WHERE priority = best)"""


def _template_profile(plus: int = 0) -> str:
    return f"""{scrolled(3, 5, plus)},
chosen AS (
  SELECT clean, coalesce(min(address) FILTER (WHERE scroll = 0 AND NOT contains(url, 'login')), 2) AS address FROM caps GROUP BY clean),
live AS (
  SELECT c.* FROM caps c JOIN chosen h ON c.clean = h.clean AND c.address = h.address WHERE NOT contains(c.url, '://m.')),
rows_ AS (
  SELECT r.req_id, l.scroll, k.pos, {strip("k.texto")} AS texto, k.href
  FROM reqs r JOIN live l ON r.clean = l.clean JOIN links k ON k.page_id = l.page_id
  WHERE l.scroll < r.last AND r.most > 0 AND {strip("k.texto")} <> ''
    AND EXISTS (SELECT 1 FROM live z WHERE z.clean = r.clean AND z.scroll = 0)),
{sighted("req_id", "texto, href", "rows_")},
{stop_rule("req_id", "least", "most", "last", "SELECT req_id, CAST(i AS BIGINT) AS scroll, least, most, last FROM reqs, unnest(generate_series(0, last - 1)) AS u(i)", "least, most, last")},
picked AS (
  SELECT CAST(s.req_id AS BIGINT) AS req_id, s.texto, 'ana' AS usuario, s.href AS "timestamp",
         row_number() OVER (PARTITION BY s.req_id ORDER BY s.scroll, s.pos) AS numero
  FROM sighted s JOIN stops t ON s.req_id = t.req_id WHERE s.scroll <= t.stop)"""


TEMPLATE_JOBS = [
    ("hashtag", "#", "_tweets.csv", lambda plus: _template_job([1, 2, 3, 4], 10, 4, LINK_KEEP_A, "a", "@ana", plus)),
    ("hashtag", "#", "_tweets_pw.csv", lambda plus: _template_job([1, 3, 2, 4], 5, 4, LINK_KEEP_B, "b", "@ana", plus)),
    ("user", "@", "_tweets.csv", lambda plus: _template_job([1], 10, 3, "true", "a", "@ana", plus)),
    ("user", "@", "_tweets_pw.csv", _template_profile),
]

# Whole visible page: block boundaries (2) and line breaks (1) as marks, then merged into line ends.
_PAGE = r"regexp_replace(html, '^.*?</head>', '', 's')"
_PAGE = rf"regexp_replace({_PAGE}, '<!--.*?-->', '', 'gs')"
_PAGE = rf"regexp_replace({_PAGE}, '[ \t\n\r\f]+', ' ', 'g')"
_PAGE = rf"regexp_replace({_PAGE}, '</?(body|html|nav|ul|li|div|article|h1|p|footer)( [^>]*)?>', chr(2), 'g')"
_PAGE = rf"regexp_replace({_PAGE}, '<br>', chr(1), 'g')"
_PAGE = decode(rf"regexp_replace({_PAGE}, '</?[a-z][^>]*>', '', 'g')")
_PAGE = rf"regexp_replace({_PAGE}, ' *([\x01\x02]) *', '\1', 'g')"
_PAGE = rf"regexp_replace({_PAGE}, '\x01?\x02+', chr(10), 'g')"
_PAGE = rf"replace({_PAGE}, chr(1), chr(10))"

ORACLE: dict[str, str] = {
    "scan_pages": "SELECT page_id, url, CAST(length(html) AS BIGINT) AS n_chars FROM pages",
    "scan_page_dumps": "SELECT page_id, CAST(length(html) AS BIGINT) AS n_chars FROM pages WHERE html IS NOT NULL",
    "candidate_urls": _urls(),
    "explode_cards_flat": f"WITH {RAW_LINKS} SELECT page_id, pos, texto FROM links",
    "explode_cards": f"WITH {LINKS} SELECT page_id, pos, n AS found, texto, href FROM links",
    "card_text_joined": f"""WITH {PARAS}
SELECT page_id, CAST(1 AS BIGINT) AS pos, string_agg(t, ' ' ORDER BY pos) AS texto
FROM (SELECT page_id, pos, {strip("inner_text")} AS t FROM paras) p WHERE t <> '' GROUP BY page_id""",
    "card_text_first": f"""WITH {PARAS}
SELECT page_id, CAST(1 AS BIGINT) AS pos, inner_text AS texto FROM paras WHERE pos = 1""",
    "card_text_visible": f"""WITH {PARAS}, {HEADINGS}
SELECT h.page_id, CAST(1 AS BIGINT) AS pos, {strip("any_value(h1) || chr(10) || chr(10) || string_agg(inner_text, chr(10) || chr(10) ORDER BY pos)")} AS texto
FROM paras p JOIN headings h ON p.page_id = h.page_id WHERE inner_text <> '' GROUP BY h.page_id""",
    "card_strict": f"""WITH {PARAS}
SELECT page_id, pos AS numero, {BOLD_FIELDS} FROM paras WHERE {BOLD_KEEP}""",
    "card_user_default": f"""WITH {PARAS}
SELECT page_id, pos, CASE WHEN bold THEN {strip("inner_text")} ELSE 'Unknown' END AS usuario FROM paras""",
    "card_attr_or_text": f"""WITH {PARAS}
SELECT page_id, pos, CASE WHEN bold THEN inner_text ELSE '' END AS "timestamp" FROM paras""",
    "page_visible_text": f"SELECT page_id, {strip(_PAGE)} AS texto FROM pages",
    "preview_sample": f"""WITH {CONV}
SELECT target, pos AS numero, usuario, substring(texto, 1, 50) || '...' AS sample
FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY pos) AS rn FROM conv) c WHERE rn <= 3""",
    "remap_flags": "SELECT doc_id AS item, quality <> 0 AS good, toxic <> 0 AS harmful FROM labels",
    "filter_nonblank": f"WITH {CONV} SELECT target, pos, texto FROM conv WHERE {strip('texto')} <> ''",
    "filter_keyword_ci": f"""WITH {DOCS}
SELECT target, pos, texto FROM docs WHERE contains(lower(texto), lower('TION'))""",
    "filter_hashtag_cs": f"""WITH {DOCS}
SELECT target, pos, texto FROM docs WHERE contains(texto, '#the') OR contains(texto, ' the ')""",
    "filter_blocked_pages": "SELECT page_id, url FROM pages WHERE NOT contains(url, 'spam-farm')",
    "quarantine_bad_rows": """SELECT page_id, TRY_CAST(part AS BIGINT) AS article,
       CASE WHEN TRY_CAST(part AS BIGINT) IS NULL THEN 'not a number: ' || part END AS error
FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+/[^/]+/([^?#]*)', 1) AS part FROM pages) p""",
    "quarantine_bad_cards": """SELECT page_id, CAST(NULL AS BIGINT) AS pos, 'no markup' AS error
FROM pages WHERE html IS NULL OR page_id % 7 = 3""",
    "filter_domains": """SELECT * FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages) p
WHERE host ILIKE '%THER%' OR host ILIKE '%x.example.net%' OR host ILIKE '%cheap-pills%'""",
    "filter_required_keys": """SELECT event_id, list_contains(json_keys(props), 'name') AS named
FROM events WHERE list_contains(json_keys(props), 'k')""",
    "group_has_any": """SELECT user_id, coalesce(bool_or(event_type IN ('purchase', 'error')), false) AS has_any
FROM events GROUP BY user_id""",
    "cap_candidates": f"WITH {CONV} SELECT target, pos FROM conv WHERE pos <= 3",
    "cap_candidates_negative": f"""WITH {CONV}
SELECT target, pos FROM (SELECT *, count(*) OVER (PARTITION BY target) AS n FROM conv) c
WHERE pos <= greatest(n - 2, 0)""",
    "cap_candidates_by_request": f"""WITH {CONV}
SELECT target, pos, most FROM (
  SELECT *, count(*) OVER (PARTITION BY target) AS n,
         4 - 5 * count(*) FILTER (WHERE usuario = 'system') OVER (PARTITION BY target) AS most FROM conv) c
WHERE pos <= CASE WHEN most >= 0 THEN most ELSE greatest(n + most, 0) END""",
    "prefix_min_a": f"""WITH {CONV}
SELECT target, pos, texto FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY pos) AS rn FROM conv
  WHERE pos <= 6 AND {strip("texto")} <> '' AND contains(lower(texto), 'en')) c WHERE rn <= 2""",
    "prefix_min_b": f"""WITH {CONV},
judged AS (SELECT *, pos <= 6 AND {strip("texto")} <> '' AND usuario <> 'system' AS keep FROM conv),
run AS (
  SELECT *, coalesce(sum(CAST(keep AS INT)) OVER (PARTITION BY target ORDER BY pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kept_before FROM judged)
SELECT target, pos, texto FROM run WHERE keep AND kept_before < 3""",
    "prefix_min_b_zero": f"WITH {CONV} SELECT target, pos, texto FROM conv WHERE usuario <> 'system' AND pos = 1",
    "prefix_min_by_request": f"""WITH {DOCS}
SELECT target, pos, CAST(least AS BIGINT) AS least FROM (
  SELECT *, floor(count(*) OVER (PARTITION BY target) / 10) AS least,
         row_number() OVER (PARTITION BY target ORDER BY pos) AS rn
  FROM docs WHERE {strip("texto")} <> '') d WHERE rn <= greatest(least, 1)""",
    "scroll_stop": f"WITH {STOPPED}",
    "scroll_stop_strict": f"SELECT * FROM (WITH {STOPPED}) x WHERE numero <= 30",
    "scroll_progress": f"""WITH {SCROLLS}, {sighted("target", "texto", "scrolls")},
{stop_rule("target", "10", "30", "10", "SELECT DISTINCT target, scroll FROM scrolls")}
SELECT c.target, c.scroll, new AS n_new, CAST(cum AS BIGINT) AS n_unique
FROM cums c JOIN stops t ON c.target = t.target WHERE c.scroll <= t.stop""",
    "shortfall_report": f"""WITH {CONV}
SELECT target, count(*) AS found, count(*) < 6 AS shortfall FROM conv GROUP BY target""",
    "number_source_pos": f"""WITH {RAW_LINKS}
SELECT page_id, pos AS numero, texto FROM links WHERE contains(lower(texto), 'th')""",
    "number_dense": """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS numero
FROM events""",
    "number_dense_sparse": """SELECT event_id, event_type, md5(CAST(event_id AS VARCHAR)) AS digest,
       row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR))) AS numero FROM events""",
    "accumulate_distinct": DISTINCT,
    "first_nonempty_source": f"""WITH {DOCS}
SELECT target, candidate, pos, texto FROM (
  SELECT *, min(priority) OVER (PARTITION BY target) AS best FROM docs
  WHERE contains(lower(texto), 'ndert')) d WHERE priority = best""",
    "first_unblocked_source": f"WITH {HOSTS} SELECT host, CAST(priority AS BIGINT) AS priority FROM unblocked",
    "skip_failed_source": f"""WITH {RAW_LINKS}
SELECT target, page_id AS priority, pos, texto FROM (
  SELECT *, min(page_id) OVER (PARTITION BY target) AS best FROM (
    SELECT *, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS target FROM links
    WHERE NOT contains(url, '://m.') AND contains(lower(texto), 'an')) k) b WHERE page_id = best""",
    "result_count": f"""WITH {DOCS}
SELECT target, candidate, count(*) AS n_rows FROM docs GROUP BY target, candidate""",
    "stage_report": f"""WITH {CONV}
SELECT target, count(*) AS found, count(*) FILTER (WHERE pos <= 6) AS inspected,
       count(*) FILTER (WHERE {strip("texto")} <> '') AS nonblank,
       count(*) FILTER (WHERE {strip("texto")} <> '' AND contains(lower(texto), 'en') AND pos <= 6) AS matched
FROM conv GROUP BY target""",
    "clean_target": f"""SELECT doc_id, substring(raw, 2) AS tag,
       CASE WHEN starts_with(bare, '@') THEN substring(bare, 2) ELSE bare END AS name
FROM (SELECT doc_id, {strip("' ' || chr(9) || '##' || text || '# '")} AS raw, {strip("text")} AS bare FROM documents) d""",
    "strip_ws": f"SELECT doc_id, {strip('text')} AS texto FROM documents",
    "clean_handle": f"SELECT doc_id, replace({strip(chr(39) + ' @' + chr(39) + ' || text || ' + chr(39) + '@ ' + chr(39))}, '@', '') AS usuario FROM documents",
    "parse_time": """SELECT event_id, CASE WHEN event_type <> 'error' THEN epoch_us(ts) // 1000 END AS millis FROM events""",
    "csv_roundtrip": """SELECT ' #' || text || ', "quoted" ' AS texto, CASE WHEN role <> 'system' THEN role END AS usuario,
       CAST(NULL AS VARCHAR) AS "timestamp", conv_id * 1000 + turn + 1 AS numero FROM conversations""",
    "csv_per_target": """SELECT CAST(conv_id AS VARCHAR) || '_tweets_pw.csv' AS file_name, count(*) AS n_rows,
       min(turn + 1) AS lowest, max(turn + 1) AS highest, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM conversations GROUP BY conv_id""",
    "csv_file_names": """SELECT doc_id, source || ' #' || lang AS name, source || ' #' || lang || '_tweets.csv' AS file_name
FROM documents""",
    "run_stamp_names": """SELECT event_id, 'user_' || CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '.csv' AS file_name
FROM events""",
    "empty_result": """SELECT text AS texto, source AS usuario, '' AS "timestamp", doc_id AS numero
FROM documents WHERE contains(lower(text), '☃ no such text')""",
    "stream_scroll_dedup": DISTINCT,
    "stream_scroll_stop": f"WITH {STOPPED}",
    "stream_scroll_holes": f"WITH {HOLES}",
    "job_hashtag_a": f"WITH {LINKS}, {JOB_HASHTAG_A} SELECT {POST} FROM picked",
    "job_hashtag_b": f"WITH {LINKS}, {JOB_HASHTAG_B} SELECT req_id - 10000000 AS req_id, texto, usuario, \"timestamp\", numero FROM picked",
    "job_user_a": f"WITH {PARAS}, {JOB_USER_A} SELECT req_id - 20000000 AS req_id, texto, usuario, \"timestamp\", numero FROM picked",
    "job_user_b": JOB_USER_B,
    "job_page_report": f"""WITH {LINKS}, {JOB_HASHTAG_A},
per_page AS (SELECT req_id, priority, count(*) AS n_posts FROM stopped GROUP BY req_id, priority),
found AS (SELECT page_id, max(n) AS n FROM links GROUP BY page_id)
SELECT CAST(r.req_id AS BIGINT) AS req_id, f.page_id AS priority, coalesce(c.n, 0) AS found,
       CAST(CASE WHEN r.most >= 0 THEN least(r.most, coalesce(c.n, 0)) ELSE greatest(coalesce(c.n, 0) + r.most, 0) END AS BIGINT) AS inspected,
       coalesce(p.n_posts, 0) AS n_posts, coalesce(c.n, 0) < r.least AS shortfall
FROM reqs r JOIN filed f ON r.clean = f.clean LEFT JOIN found c ON c.page_id = f.page_id
     LEFT JOIN per_page p ON p.req_id = r.req_id AND p.priority = f.page_id
WHERE NOT contains(f.url, '://m.') AND NOT contains(f.url, 'spam-farm')""",
    "job_error_report": f"""WITH {GRID}, {BOOK}, {reqs()}
SELECT CAST(r.req_id AS BIGINT) AS req_id, f.page_id AS priority, f.url AS requested_url, 'no markup' AS page_error, CAST(0 AS BIGINT) AS bad_cards
FROM reqs r JOIN filed f ON r.clean = f.clean WHERE f.page_id % 7 = 3 AND NOT contains(f.url, '://m.') AND NOT contains(f.url, 'spam-farm')""",
    **{
        f"job_{kind}_{engine}_templates": f"WITH {LINKS}, {job(0)} SELECT {POST} FROM picked"
        for (kind, _, _, job), engine in zip(TEMPLATE_JOBS, "abab")
    },
    "requests_to_csv": f"""SELECT file_name, count(*) AS n_rows, CAST(sum(numero) AS BIGINT) AS numbers, CAST(sum(length(texto)) AS BIGINT) AS n_chars
FROM ({" UNION ALL ".join(f"SELECT p.*, ' {sigil}' || clean || '{suffix}' AS file_name FROM (WITH {LINKS}, {job(0)} SELECT picked.*, clean FROM picked JOIN reqs USING (req_id)) p" for _, sigil, suffix, job in TEMPLATE_JOBS)}) x GROUP BY file_name""",
    "request_batch": f"WITH {BATCH} SELECT {POST} FROM got",
    "request_report": f"""WITH {GRID}, {BOOK},
asked AS (
  {" UNION ALL ".join(f"SELECT req_id, clean, least, '{k}' AS kind, '{e}' AS engine FROM (WITH {reqs(p)} SELECT * FROM reqs) q{p}" for k, e, p in (("hashtag", "a", 0), ("hashtag", "b", 10_000_000), ("user", "a", 20_000_000), ("user", "b", 30_000_000)))}),
{BATCH},
counted AS (SELECT req_id, count(*) AS n FROM got GROUP BY req_id)
SELECT CAST(a.req_id AS BIGINT) AS req_id, kind, engine, clean, coalesce(n, 0) AS n_rows, coalesce(n, 0) < least AS short_of_min
FROM asked a LEFT JOIN counted c ON a.req_id = c.req_id""",
    "failed_requests": """SELECT page_id AS req_id, url AS target FROM pages WHERE contains(url, '://m.')""",
}
