"""Queries of the identity audit, over archives derived from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as ident
from ..functions import fixed
from ..operators import audit, coverage, identity, issues, sequences
from ..session import stored
from . import coverage as sources
from . import records
from .registry import query, with_

# One archive per order line: the series is the order, the chapter the line
# number.  Line flags decide between chapters, volumes and Specials, and part
# and supplier keys plant the faults.
ARCHIVES = r"""
SELECT
  CASE WHEN l_partkey % 101 = 0 THEN '' WHEN l_partkey % 23 = 0 THEN 'Other ' || CAST(l_orderkey % 10 AS STRING) || '/'
       ELSE 'Series ' || CAST(l_orderkey AS STRING) || '/' END
  || 'Series ' || CAST(l_orderkey AS STRING) || ' '
  || CASE WHEN l_returnflag = 'R' AND l_suppkey % 5 = 0 THEN
            CASE WHEN l_partkey % 13 = 0 THEN 'v00' WHEN l_partkey % 11 = 0 THEN 'v' || CAST(l_suppkey AS STRING) || ' Ch.1'
                 ELSE 'v' || CAST(l_suppkey AS STRING) END
          WHEN l_returnflag = 'N' AND l_partkey % 7 = 0 THEN
            CASE WHEN l_partkey % 13 = 0 THEN 'extra' ELSE 'SP0' || CAST(l_linenumber AS STRING) END
          WHEN l_partkey % 13 = 0 THEN 'Ch.099'
          WHEN l_partkey % 17 = 0 THEN 'part'
          WHEN l_suppkey % 4 = 0 THEN 'Vol.' || CAST(l_suppkey AS STRING) || ' Ch.00' || CAST(l_linenumber AS STRING)
          ELSE 'Ch.00' || CAST(l_linenumber AS STRING) END
  || ' [' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || ']' || '.cbz' AS path,
  CASE WHEN l_partkey % 97 = 0 THEN '  ' WHEN l_partkey % 2 = 0 THEN 'SERIES  ' || CAST(l_orderkey AS STRING) || ' '
       ELSE 'Series ' || CAST(l_orderkey AS STRING) END AS series,
  CASE WHEN l_partkey % 31 = 0 THEN 'Other' END AS localized_series,
  CASE WHEN l_partkey % 37 = 0 THEN 'Sort' ELSE 'series ' || CAST(l_orderkey AS STRING) END AS series_sort,
  CASE WHEN l_returnflag = 'R' AND l_suppkey % 5 = 0 THEN CAST(NULL AS STRING)
       WHEN l_returnflag = 'N' AND l_partkey % 7 = 0 THEN 'SP' || CAST(l_linenumber AS STRING)
       WHEN l_partkey % 29 = 0 THEN 'n/a'
       WHEN l_partkey % 19 = 0 THEN CAST(l_linenumber AS STRING) || '.50'
       ELSE ' 0' || CAST(l_linenumber AS STRING) END AS number,
  CASE WHEN l_returnflag = 'R' AND l_suppkey % 5 = 0 THEN CAST(l_suppkey AS STRING)
       WHEN l_returnflag = 'N' AND l_partkey % 7 = 0 THEN CASE WHEN l_partkey % 14 = 0 THEN '1' END
       WHEN l_returnflag = 'A' AND l_suppkey % 3 = 0 THEN CAST(l_suppkey AS STRING) || '.0' END AS volume,
  CASE WHEN l_returnflag = 'N' AND l_partkey % 7 = 0 AND l_partkey % 3 <> 0 THEN ' Special' END AS format,
  CASE WHEN l_suppkey % 2 = 0 THEN '特别篇' ELSE 'Extra' END AS title
FROM lineitem"""

# Policies and documented gaps per series, from the orders.
POLICIES = """
SELECT 'Series ' || CAST(o_orderkey AS STRING) AS series,
  CASE o_orderstatus WHEN 'O' THEN 'continuous-chapter' WHEN 'F' THEN 'Volume_Aware_Chapter' ELSE 'volume-only' END AS policy,
  o_orderkey AS seq
FROM orders WHERE o_custkey % 3 <> 0"""
DOCUMENTED = """
SELECT 'series ' || CAST(o_orderkey AS STRING) AS series_key, CAST(2 AS BIGINT) AS "start", CAST(3 AS BIGINT) AS "end"
FROM orders WHERE o_custkey % 4 = 0
UNION ALL
SELECT 'series ' || CAST(o_orderkey AS STRING), CAST(3 AS BIGINT), CAST(5 AS BIGINT)
FROM orders WHERE o_custkey % 8 = 0"""

NUM = "TRY_CAST(trim({}) AS DECIMAL(30,6))"
TXT = "rtrim(rtrim(CAST({} AS VARCHAR), '0'), '.')"
ITEMS = rf"""
SELECT *, CASE WHEN series_key IS NULL THEN NULL WHEN is_special THEN 'special' WHEN number_id IS NOT NULL THEN 'chapter'
               WHEN volume_id IS NOT NULL THEN 'volume' ELSE 'none' END AS kind
FROM (
  SELECT a.*, coalesce(p.policy, 'continuous-chapter') AS policy,
    nullif(regexp_extract(number, '(?i)^SP[\s._-]*([0-9]+(?:\.[0-9]+)?)$', 1), '') AS special,
    coalesce(lower(trim(format)) = 'special', false)
      OR coalesce(regexp_matches(number, '(?i)^SP[\s._-]*[0-9]+(\.[0-9]+)?$'), false) AS is_special
  FROM (
    SELECT *, nullif(lower(trim(regexp_replace(series, '\s+', ' ', 'g'))), '') AS series_key,
      split_part(path, '/', 1) AS folder,
      regexp_extract(path, '([^/]*)\.cbz$', 1) AS stem,
      {NUM.format('number')} AS num,
      {TXT.format(NUM.format('number'))} AS number_id,
      {TXT.format(NUM.format('volume'))} AS volume_id
    FROM archives) a
  LEFT JOIN (SELECT lower(series) AS series_key, arg_max(replace(lower(policy), '_', '-'), seq) AS policy
             FROM policies GROUP BY 1) p USING (series_key))"""
IDENTIFIED = """
SELECT *, CASE kind WHEN 'special' THEN coalesce(special, number, '')
    WHEN 'chapter' THEN CASE WHEN policy = 'volume-aware-chapter' AND volume_id IS NOT NULL
                             THEN volume_id || ':' || number_id ELSE number_id END
    WHEN 'volume' THEN volume_id END AS identity
FROM items0"""
BASE = dict(archives=ARCHIVES, policies=POLICIES, items0=ITEMS, items=IDENTIFIED)
CHAPTERS = """
SELECT DISTINCT series_key, CAST(num AS BIGINT) AS chapter FROM items
WHERE kind = 'chapter' AND policy = 'continuous-chapter' AND num = floor(num)"""
ABSENT = """
SELECT b.series_key, b.n FROM (
  SELECT series_key, unnest(range(lo, hi)) AS n
  FROM (SELECT series_key, min(chapter) AS lo, max(chapter) AS hi FROM chapters GROUP BY 1)) b
ANTI JOIN chapters c ON c.series_key = b.series_key AND c.chapter = b.n"""
DOCUMENTED_NUMBERS = """SELECT DISTINCT series_key, unnest(range("start", "end" + 1)) AS n FROM documented"""
ISLANDS = """SELECT series_key, min(n) AS "start", max(n) AS "end" FROM (
  SELECT series_key, n, n - row_number() OVER (PARTITION BY series_key ORDER BY n) AS g FROM {}) GROUP BY series_key, g"""


def archives(t):
    return t.sql(ARCHIVES)


def policies(t):
    return identity.resolve_policies(t.sql(POLICIES))


def items(t):
    return identity.classify(archives(t), policies(t))


def documented(t):
    return t.sql(DOCUMENTED.replace('"start"', "`start`").replace('"end"', "`end`"))


@query("series_audit", with_(
    **BASE, chapters=CHAPTERS, documented=DOCUMENTED, dnum=DOCUMENTED_NUMBERS, absent=ABSENT,
    undocumented="SELECT * FROM absent ANTI JOIN dnum USING (series_key, n)",
    islands=ISLANDS.format("undocumented"),
    ids="""SELECT series_key, kind, identity, count(*) AS n, bool_or(volume_id IS NOT NULL) AS w, bool_or(volume_id IS NULL) AS wo
           FROM items WHERE identity IS NOT NULL GROUP BY ALL""",
) + """
SELECT s.series_key, s.identity_policy,
  coalesce(normal_chapter_count, 0) AS normal_chapter_count, coalesce(special_count, 0) AS special_count,
  coalesce(volume_fallback_count, 0) AS volume_fallback_count,
  coalesce(w, false) AS has_chapters_with_volume, coalesce(w AND wo, false) AS partial_volume_tagging,
  coalesce(duplicate_identities, 0) AS duplicate_identities,
  coalesce(unintended_gaps, 0) AS unintended_gaps, CAST(coalesce(gap_chapters, 0) AS BIGINT) AS unintended_gap_chapters,
  coalesce(confirmed, 0) AS confirmed_source_gaps
FROM (SELECT series_key, max(policy) AS identity_policy FROM items WHERE series_key IS NOT NULL GROUP BY 1) s
LEFT JOIN (SELECT series_key, count(*) FILTER (kind = 'chapter') AS normal_chapter_count,
    count(*) FILTER (kind = 'special') AS special_count, count(*) FILTER (kind = 'volume') AS volume_fallback_count,
    count(*) FILTER (n > 1) AS duplicate_identities,
    bool_or(w) FILTER (kind = 'chapter') AS w, bool_or(wo) FILTER (kind = 'chapter') AS wo
  FROM ids GROUP BY 1) USING (series_key)
LEFT JOIN (SELECT series_key, count(*) AS unintended_gaps, sum("end" - "start" + 1) AS gap_chapters FROM islands GROUP BY 1) USING (series_key)
LEFT JOIN (SELECT series_key, count(*) AS confirmed FROM dnum GROUP BY 1) USING (series_key)""")
def series_audit(t):
    return identity.series_audit(items(t), documented(t))


@query("sequence_gaps", with_(**BASE, chapters=CHAPTERS, absent=ABSENT) + ISLANDS.format("absent"))
def sequence_gaps(t):
    return sequences.sequence_gaps(identity.chapter_numbers(items(t)))


@query("sequence_gaps_control", with_(
    chapters="SELECT DISTINCT CAST(conv_id AS VARCHAR) AS series_key, turn AS chapter FROM conversations", absent=ABSENT, islands=ISLANDS.format("absent")) + """
SELECT count(*) AS gaps, (SELECT count(DISTINCT series_key) FROM chapters) AS series FROM islands""")
def sequence_gaps_control(t):
    turns = t.conversations.select(F.col("conv_id").cast("string").alias("series_key"), F.col("turn").alias("chapter"))
    gaps = sequences.sequence_gaps(turns.distinct()).select("series_key", F.lit(1).alias("gap"))
    every = turns.select("series_key", F.lit(0).alias("gap"))
    return gaps.unionByName(every).agg(
        F.sum("gap").cast("bigint").alias("gaps"), F.count_distinct("series_key").alias("series")
    )


@query("gaps_minus_documented", with_(
    **BASE, chapters=CHAPTERS, documented=DOCUMENTED, dnum=DOCUMENTED_NUMBERS, absent=ABSENT,
    undocumented="SELECT * FROM absent ANTI JOIN dnum USING (series_key, n)",
) + ISLANDS.format("undocumented"))
def gaps_minus_documented(t):
    return sequences.sequence_gaps(identity.chapter_numbers(items(t)), documented(t))


RANGES = """
SELECT 'series ' || CAST(o_orderkey AS STRING) AS series_key, CAST({} AS BIGINT) AS "start", CAST({} AS BIGINT) AS "end"
FROM orders WHERE o_custkey % {} = 0"""
IGNORED, FALLBACK = RANGES.format(4, 4, 5), RANGES.format(1, "o_custkey % 7", 3)


def _ranges(t, text):
    return t.sql(text.replace('"start"', "`start`").replace('"end"', "`end`"))


@query("gap_classes", with_(
    **BASE, chapters=CHAPTERS, documented=DOCUMENTED, ignored=IGNORED, fallback=FALLBACK, absent=ABSENT,
    classed="""SELECT series_key, n,
      CASE WHEN EXISTS (FROM documented d WHERE d.series_key = a.series_key AND a.n BETWEEN d."start" AND d."end") THEN 'CONFIRMED_SOURCE_GAP'
           WHEN EXISTS (FROM ignored d WHERE d.series_key = a.series_key AND a.n BETWEEN d."start" AND d."end") THEN 'USER_IGNORED_DAMAGED_ITEM'
           WHEN EXISTS (FROM fallback d WHERE d.series_key = a.series_key AND a.n BETWEEN d."start" AND d."end") THEN 'FALLBACK_COVERED_UNNUMBERED_RANGE'
           ELSE 'UNINTENDED_GAP' END AS code FROM absent a""",
) + """
SELECT series_key, code, count(*) AS chapters, min(n) AS first, max(n) AS last, CAST(NULL AS VARCHAR) AS volume
FROM classed GROUP BY series_key, code
UNION ALL
SELECT 'series ' || CAST(o_orderkey AS VARCHAR), 'UNMAPPED_SOURCE_ABSENCE', CAST(0 AS BIGINT), NULL, NULL, CAST(o_custkey AS VARCHAR)
FROM orders WHERE o_custkey % 50 = 0""")
def gap_classes(t):
    absent = t.orders.filter("o_custkey % 50 = 0").selectExpr(
        "'series ' || o_orderkey AS series_key", "o_custkey AS volume"
    )
    pieces = sequences.classify_gaps(identity.chapter_numbers(items(t)), documented(t), _ranges(t, IGNORED), _ranges(t, FALLBACK), absent)
    return pieces.groupBy("series_key", "code", "volume").agg(
        F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).cast("bigint").alias("chapters"),
        F.min("start").alias("first"), F.max("end").alias("last"),
    )


@query("duplicate_identities", with_(**BASE) + """
SELECT series_key, kind, identity, path,
  count(*) OVER w AS copies, min(path) OVER w AS first_path,
  CASE kind WHEN 'chapter' THEN 'DUPLICATE_CHAPTER_IDENTITY' ELSE 'duplicate_series_identity' END AS code
FROM items WHERE identity IS NOT NULL
WINDOW w AS (PARTITION BY series_key, kind, identity) QUALIFY copies > 1""")
def duplicate_identities(t):
    return identity.duplicate_identities(items(t))


@query("partial_volume", with_(**BASE) + """
SELECT series_key, unnest(['SERIES_IDENTITY_MIX', 'PARTIAL_VOLUME_TAGGING']) AS code
FROM items WHERE kind = 'chapter' GROUP BY series_key
HAVING count(volume_id) > 0 AND count(volume_id) < count(*)""")
def partial_volume(t):
    return identity.partial_volume(items(t))


@query("folder_series", with_(**BASE, pairs="SELECT DISTINCT folder, series_key FROM items WHERE series_key IS NOT NULL") + """
SELECT 'mixed_series_folder' AS code, folder AS subject, series_key AS member, count(*) OVER (PARTITION BY folder) AS others
FROM pairs QUALIFY others > 1
UNION ALL
SELECT 'series_split_across_folders', series_key, folder, count(*) OVER (PARTITION BY series_key) AS others
FROM pairs QUALIFY others > 1""")
def folder_series(t):
    return identity.folder_series_issues(items(t))


@query("resolve_policies", """
SELECT CAST(user_id AS VARCHAR) AS series_key,
  arg_max(policy, event_id) AS policy, min(policy) <> max(policy) AS conflict,
  bool_or(policy NOT IN ('continuous-chapter', 'volume-aware-chapter', 'volume-only')) AS unknown
FROM (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'continuous-chapter' WHEN 'view' THEN 'volume-aware-chapter'
        WHEN 'signup' THEN 'volume-only' WHEN 'purchase' THEN 'mystery' END AS policy FROM events)
WHERE policy IS NOT NULL GROUP BY user_id""")
def resolve_policies(t):
    records = t.events.selectExpr(
        "CAST(user_id AS STRING) AS series",
        """CASE event_type WHEN 'click' THEN 'continuous_chapter' WHEN 'view' THEN 'Volume-Aware-Chapter'
           WHEN 'signup' THEN 'VOLUME_ONLY' WHEN 'purchase' THEN 'mystery' END AS policy""",
        "event_id AS seq",
    )
    return identity.resolve_policies(records)


TOKEN_SQL = dict(
    ch=r"nullif(regexp_extract(stem, '(?i)(?:^|[\s._-])ch(?:apter)?[\s._-]*([0-9]+(?:\.[0-9]+)?)', 1), '')",
    vol=r"nullif(regexp_extract(stem, '(?i)(?:^|[\s._-])(?:vol(?:ume)?|v)[\s._-]*([0-9]+(?:\.[0-9]+)?)', 1), '')",
    sp=r"nullif(regexp_extract(stem, '(?i)(?:^|[\s._-])SP[\s._-]*([0-9]+(?:\.[0-9]+)?)', 1), '')",
    hasvol=r"regexp_matches(stem, '(?i)(?:^|[\s._-])vol(?:ume)?[\s._-]*[0-9]+|(?:^|[\s._-])v[0-9]+')",
)
TOKENS = "SELECT *, {ch} AS ch, {vol} AS vol, {sp} AS sp, {hasvol} AS hasvol FROM items".format(**TOKEN_SQL)


def _case(condition: str, code: str, message: str) -> str:
    return f"SELECT '{code}' AS code, path AS subject, '{message}' AS message FROM tokens WHERE {condition}"


def _canon(expression: str) -> str:
    return TXT.format(NUM.format(expression))


ISSUES = " UNION ALL ".join([
    _case("path NOT LIKE '%/%'", "media_at_library_root", "path.nested"),
    _case("series_key IS NULL", "series_missing", "series.present"),
    _case("localized_series <> '' AND lower(localized_series) <> series_key", "series_identity_mix", "series.equals-LocalizedSeries"),
    _case("series_sort <> '' AND lower(series_sort) <> series_key", "series_identity_mix", "series.equals-SeriesSort"),
    _case("kind = 'special' AND (coalesce(lower(trim(format)) <> 'special', true) OR special IS NULL)", "invalid_special_identity", "special.format-and-number"),
    _case(f"kind = 'special' AND (sp IS NULL OR {_canon('sp')} IS DISTINCT FROM {_canon('identity')})", "special_filename_identity_mismatch", "special.name-number"),
    _case("kind = 'special' AND volume_id IS NOT NULL", "invalid_special_identity", "special.no-volume"),
    _case("kind = 'special' AND title = 'Extra'", "META008", "special.title-han"),
    _case("kind = 'special' AND NOT documented", "SPECIAL_RANGE_INCOMPLETE", "special.documented"),
    _case("kind = 'chapter' AND ch IS NULL", "chapter_filename_identity_missing", "chapter.name-token"),
    _case(f"kind = 'chapter' AND ch IS NOT NULL AND {_canon('ch')} <> number_id", "chapter_filename_identity_mismatch", "chapter.name-number"),
    _case("kind = 'chapter' AND policy = 'continuous-chapter' AND volume_id IS NOT NULL", "KAVITA_VOLUME_JUMP_RISK", "chapter.no-volume"),
    _case("kind = 'chapter' AND policy = 'continuous-chapter' AND hasvol", "KAVITA_VOLUME_JUMP_RISK", "chapter.name-without-volume"),
    _case("kind = 'chapter' AND policy = 'volume-aware-chapter' AND volume_id IS NULL", "volume_aware_chapter_missing_volume", "chapter.volume"),
    _case(f"kind = 'chapter' AND policy = 'volume-aware-chapter' AND volume_id IS NOT NULL AND {_canon('vol')} IS DISTINCT FROM volume_id", "volume_filename_identity_mismatch", "chapter.name-volume"),
    _case("kind = 'chapter' AND policy = 'volume-only'", "volume_only_has_chapter", "chapter.policy"),
    _case("kind = 'volume' AND policy <> 'volume-only' AND NOT documented", "UNDOCUMENTED_VOLUME_FALLBACK", "fallback.documented"),
    _case("kind = 'volume' AND ch IS NOT NULL", "fallback_filename_has_chapter", "fallback.name-without-chapter"),
    _case(f"kind = 'volume' AND {_canon('vol')} IS DISTINCT FROM volume_id", "volume_filename_identity_mismatch", "fallback.name-volume"),
    _case("kind = 'none'", "archive_identity_missing", "item.identified"),
])
ISSUE_BASE = dict(**BASE, tokens0=TOKENS, tokens="SELECT *, length(path) % 3 = 0 AS documented FROM tokens0", issues=ISSUES)


def identity_issue_rows(t):
    """Row issues of the archives; every third path length has a plan record."""
    plan = archives(t).filter(F.length("path") % 3 == 0)
    return identity.identity_issues(items(t), plan)


@query("identity_issues", with_(**ISSUE_BASE) + "SELECT * FROM issues")
def identity_issues(t):
    return identity_issue_rows(t)


SEVERITY = """CASE code WHEN 'META008' THEN 'REVIEW' WHEN 'SPECIAL_RANGE_INCOMPLETE' THEN 'REVIEW'
  WHEN 'KAVITA_VOLUME_JUMP_RISK' THEN 'REVIEW/BLOCKER' ELSE 'BLOCKER' END"""


@query("issue_severity", with_(**ISSUE_BASE) + f"""
SELECT code, CASE code WHEN 'META008' THEN 'metadata' WHEN 'SPECIAL_RANGE_INCOMPLETE' THEN 'run'
    WHEN 'KAVITA_VOLUME_JUMP_RISK' THEN 'identity' WHEN 'UNDOCUMENTED_VOLUME_FALLBACK' THEN 'identity' ELSE 'validation' END AS area,
  {SEVERITY} AS severity, count(*) AS issues FROM (SELECT DISTINCT * FROM issues) GROUP BY code""")
def issue_severity(t):
    return (
        issues.with_severity(issues.all_issues(identity_issue_rows(t)))
        .groupBy("code", "area", "severity").agg(F.count("*").alias("issues"))
    )


CODE_SEVERITY = "CASE code " + " ".join(f"WHEN '{c}' THEN '{level}'" for c, (_, level) in fixed.ISSUE_CODES.items()) + " ELSE 'BLOCKER' END"
CODE_AREA = "CASE code " + " ".join(f"WHEN '{c}' THEN '{area}'" for c, (area, _) in fixed.ISSUE_CODES.items()) + " ELSE 'validation' END"


# The tables of a whole library, beside the archives: members, page counts, manifests, plan records.
LIBRARY = ARCHIVES.replace("\nFROM lineitem", ", l_partkey + l_suppkey AS x, ((l_orderkey * 20011 + l_partkey) * 1009 + l_suppkey) * 8 + l_linenumber AS n, l_orderkey AS o FROM lineitem")
LIB_MEMBERS = """
SELECT path AS archive, CAST(k AS INT) AS member_index, CASE
    WHEN k = 0 THEN CASE WHEN x % 41 = 0 THEN 'sub/comicinfo.xml' WHEN x % 43 = 0 THEN 'notes.txt' ELSE 'ComicInfo.xml' END
    WHEN (x + k) % 97 = 0 THEN '../p' || CAST(k AS STRING) || '.jpg' WHEN k = 1 AND x % 37 = 0 THEN 'x/COMICINFO.xml' ELSE 'p' || CAST(k AS STRING) || '.jpg' END AS name,
  CAST(1000 + x AS BIGINT) AS file_size, CASE WHEN (x + k) % 101 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(900 AS BIGINT) END AS compress_size,
  CASE WHEN (x + k) % 103 = 0 THEN 1 ELSE 0 END AS flag_bits,
  CASE WHEN (x + k) % 107 = 0 THEN CAST(2717843456 AS BIGINT) ELSE CAST(2175008768 AS BIGINT) END AS external_attr, false AS is_dir,
  CASE WHEN (x + k) % 19 = 0 THEN 'shared ' || CAST(o AS STRING) ELSE path || CAST(k AS STRING) END AS sha256
FROM {}, (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10)) v(k) WHERE k <= x % 11"""
LIB_DECLARED = "SELECT path AS archive, CASE WHEN x % 13 = 0 THEN 'many' WHEN x % 17 = 0 THEN CAST(x % 11 + 1 AS STRING) ELSE CAST(x % 11 AS STRING) END AS declared FROM {}"
LIB_FILES = "SELECT path, 'h' || CAST(n AS STRING) AS sha256 FROM {}"
LIB_RECORDED = """
SELECT CASE WHEN x % 59 = 0 THEN '../' || path WHEN x % 61 = 0 THEN 'gone/' || path ELSE path END AS path,
  CASE WHEN x % 31 = 0 THEN 'old' ELSE 'H' || CAST(n AS STRING) END AS sha256 FROM {} WHERE x % 3 <> 0"""
LIB_LISTED = """
SELECT CASE WHEN x % 67 = 0 THEN 'extra/' || path ELSE path END AS path, CASE WHEN x % 29 = 0 THEN 'old' ELSE 'h' || CAST(n AS STRING) END AS sha256 FROM {} WHERE x % 7 <> 0"""
LIB_RECORDS = """
SELECT n AS doc_seq, CASE n % 5 WHEN 0 THEN './' || path WHEN 1 THEN 'elsewhere/' || regexp_extract(path, '([^/]*)$', 1) END AS path, CASE WHEN n % 4 <> 0 THEN upper(series) END AS series,
  CASE WHEN n % 6 <> 0 THEN volume || '.0' END AS volume, lower(number) AS number, """ + records.FALLBACK_DOCS.split(f"{records.C}, ", 1)[1].replace(records.C, "x").replace(
    "FROM orders", "FROM {} WHERE (number IS NULL OR number LIKE 'SP%') AND n % 7 <> 0")
LIB_SQL = dict(
    members=LIB_MEMBERS.format("archives"), declared=LIB_DECLARED.format("archives"), files=LIB_FILES.format("archives"),
    recorded=LIB_RECORDED.format("archives"), listed=LIB_LISTED.format("archives"), records=LIB_RECORDS.replace("{} WHERE (", "archives WHERE ("),
    ok="SELECT *, NOT (name LIKE '../%' OR (external_attr >> 16) & 61440 = 40960 OR flag_bits % 2 = 1 OR file_size > greatest(compress_size, 1) * 1000) AS ok FROM members",
    mf="""SELECT archive AS path, count(*) AS n, count(*) FILTER (ok AND name LIKE '%.jpg') AS pages, count(*) FILTER (ok AND regexp_matches(lower(name), '(^|/)comicinfo[.]xml$')) AS meta,
            count(*) FILTER (ok AND name = 'ComicInfo.xml') AS root FROM ok GROUP BY 1""",
    ff="SELECT path, max(sha256) AS sha256 FROM files GROUP BY 1", rf="SELECT path, min(lower(sha256)) AS a, max(lower(sha256)) AS b FROM recorded GROUP BY 1",
    lf="SELECT path, min(lower(sha256)) AS a, max(lower(sha256)) AS b FROM listed GROUP BY 1",
    df="SELECT d.path, declared, coalesce(pages, 0) AS pages FROM (SELECT archive AS path, max(declared) AS declared FROM declared GROUP BY 1) d LEFT JOIN mf USING (path)",
    d="""SELECT doc_seq, x, CASE WHEN starts_with(path, './') THEN substr(path, 3) ELSE path END AS p, regexp_extract(path, '[^/]*$') AS name, lower(trim(regexp_replace(series, '\\s+', ' ', 'g'))) AS s,
           """ + TXT.format(NUM.format("volume")) + """ AS v, replace(lower(number), ' ', '') AS u FROM (SELECT r.*, a.x FROM records r JOIN (SELECT DISTINCT n, x FROM archives) a ON a.n = r.doc_seq)""",
    a="""SELECT DISTINCT path, kind, regexp_extract(path, '[^/]*$') AS name, series_key AS s, CASE kind WHEN 'volume' THEN volume_id ELSE replace(lower(number), ' ', '') END AS v
         FROM items WHERE kind IN ('volume', 'special')""",
    w="""SELECT a.path, a.kind, doc_seq, d.x FROM a JOIN d ON d.p = a.path UNION SELECT a.path, a.kind, doc_seq, d.x FROM a JOIN d USING (name)
         UNION SELECT a.path, a.kind, doc_seq, d.x FROM a JOIN d ON d.s = a.s AND CASE a.kind WHEN 'volume' THEN d.v ELSE d.u END = a.v""",
    z="""SELECT w.path, w.kind, w.doc_seq, w.x, CASE WHEN d.p = a.path THEN 100 WHEN d.name = a.name THEN 50 ELSE 0 END + CASE WHEN d.s = a.s THEN 10 ELSE 0 END
           + CASE WHEN CASE a.kind WHEN 'volume' THEN d.v ELSE d.u END = a.v THEN 10 ELSE 0 END AS score FROM w JOIN a USING (path, kind) JOIN d USING (doc_seq)""",
    matched="SELECT path, kind, arg_max(x, (score, -doc_seq)) AS x FROM z WHERE score >= 20 GROUP BY path, kind",
    held="SELECT DISTINCT archive AS path, sha256, series_key FROM members JOIN items ON items.path = archive WHERE name LIKE '%.jpg' AND series_key IS NOT NULL",
    sharing="SELECT DISTINCT path FROM (SELECT path, count(*) OVER (PARTITION BY series_key, sha256) AS c FROM held) WHERE c > 1",
    ev="""SELECT m.path, m.x, m.x AS """ + records.C + """, coalesce(pages, 0) AS pages, s.path IS NOT NULL AS shared FROM matched m LEFT JOIN mf USING (path) LEFT JOIN sharing s USING (path) WHERE kind = 'volume'""",
)
LIB_ISSUES = """
  UNION ALL SELECT CASE WHEN name LIKE '../%' THEN 'unsafe_archive_path' WHEN (external_attr >> 16) & 61440 = 40960 THEN 'archive_symlink' WHEN flag_bits % 2 = 1 THEN 'encrypted_archive_member'
      ELSE 'archive_expansion_ratio' END, archive || ' | ' || name, 'member.accepted' FROM ok WHERE NOT ok
  UNION ALL SELECT CASE WHEN meta > 1 THEN 'ARC006' ELSE 'ARC005' END, path, CASE WHEN meta > 1 THEN 'metadata.once' ELSE 'metadata.at-root' END FROM mf WHERE meta <> 1 OR root <> 1
  UNION ALL SELECT 'pagecount_mismatch', path, 'pages.counted' FROM df WHERE TRY_CAST(declared AS BIGINT) IS DISTINCT FROM pages
  UNION ALL SELECT 'archive_has_no_pages', path, 'pages.any' FROM df WHERE pages = 0
  UNION ALL SELECT 'unsafe_baseline_path', path, 'manifest.path-safe' FROM rf WHERE path LIKE '../%'
  UNION ALL SELECT 'baseline_file_missing', path, 'manifest.present' FROM rf ANTI JOIN ff USING (path) WHERE path NOT LIKE '../%'
  UNION ALL SELECT 'baseline_hash_changed', path, 'manifest.hash-equal' FROM rf JOIN ff USING (path) WHERE a <> sha256 OR b <> sha256
  UNION ALL SELECT unnest(['checksums_target_missing', 'checksums_archive_coverage_extra']), path, unnest(['checksums.target-present', 'checksums.within-library']) FROM lf ANTI JOIN ff USING (path)
  UNION ALL SELECT 'checksums_mismatch', path, 'checksums.hash-equal' FROM lf JOIN ff USING (path) WHERE a <> sha256 OR b <> sha256
  UNION ALL SELECT 'checksums_archive_coverage_missing', path, 'checksums.covers-archives' FROM ff ANTI JOIN lf USING (path)
""" + "".join(
    f"  UNION ALL SELECT 'invalid_volume_fallback', path, '{message}' FROM ev WHERE {condition}\n"
    for condition, message in [r for r in records.FALLBACK_RULES if r[1] not in ("fallback.page-count", "overlap.exact-equal")]
    + [("pages <> 10", "fallback.page-count"), (f"{records.HAS} AND shared", "overlap.exact-resolved")]
)


@query("library_audit", with_(
    **(BASE | dict(archives=LIBRARY)), **LIB_SQL, tokens0=TOKENS,
    tokens="SELECT t.*, m.path IS NOT NULL AS documented FROM tokens0 t LEFT JOIN (SELECT DISTINCT path FROM matched) m USING (path)", issues=ISSUES,
    chapters=CHAPTERS, documented=DOCUMENTED, dnum=DOCUMENTED_NUMBERS, absent=ABSENT,
    undocumented="SELECT * FROM absent ANTI JOIN dnum USING (series_key, n)", islands=ISLANDS.format("undocumented"),
    pairs="SELECT DISTINCT folder, series_key FROM items WHERE series_key IS NOT NULL",
    spans=sources.SPANS, c="SELECT source, max(pages) AS pages FROM (" + sources.COUNTS + ") GROUP BY 1", o=sources.SPAN_ORDER,
    every="SELECT code, subject, message FROM issues" + """
      UNION ALL SELECT 'mixed_series_folder', folder || ' | ' || series_key, 'folder.one-series' FROM pairs QUALIFY count(*) OVER (PARTITION BY folder) > 1
      UNION ALL SELECT 'series_split_across_folders', series_key || ' | ' || folder, 'series.one-folder' FROM pairs QUALIFY count(*) OVER (PARTITION BY series_key) > 1
      UNION ALL SELECT CASE kind WHEN 'chapter' THEN 'DUPLICATE_CHAPTER_IDENTITY' ELSE 'duplicate_series_identity' END, path, 'identity.once'
        FROM items WHERE identity IS NOT NULL QUALIFY count(*) OVER (PARTITION BY series_key, kind, identity) > 1
      UNION ALL SELECT unnest(['SERIES_IDENTITY_MIX', 'PARTIAL_VOLUME_TAGGING']), series_key, 'series.volume-tagging' FROM items WHERE kind = 'chapter'
        GROUP BY series_key HAVING count(volume_id) > 0 AND count(volume_id) < count(*)
      UNION ALL SELECT 'UNINTENDED_GAP', series_key || ' | ' || "start" || ' | ' || "end", 'sequence.complete' FROM islands
      UNION ALL SELECT code, concat_ws(' | ', source, CAST(item_index AS VARCHAR)), 'source.spans' FROM (""" + sources.SPAN_FAULTS + ")" + LIB_ISSUES,
) + f"SELECT DISTINCT code, subject, message, {CODE_AREA} AS area, {CODE_SEVERITY} AS severity FROM every")
def library_audit(t):
    """Every check of the archives, their members, manifests, records and series, as one report."""
    archives = stored(t.sql(LIBRARY), "library")
    archives.createOrReplaceTempView("given_library")
    given = lambda text: t.spark.sql(text.replace("{} WHERE (", "given_library WHERE (").replace("FROM {}", "FROM given_library"))
    rows = identity.classify(archives, policies(t))
    counts = t.sql(sources.COUNTS).groupBy("source").agg(F.max("pages").alias("pages"))
    return audit.whole_library(
        rows, given(LIB_MEMBERS), given(LIB_FILES), given(LIB_DECLARED), given(LIB_RECORDED), given(LIB_LISTED), given(LIB_RECORDS), documented(t),
        [audit.span_issues(coverage.span_issues(sources.spans(t), counts))],
    )


@query("promotion_gate", with_(
    **ISSUE_BASE, runs="SELECT split_part(subject, '/', 1) AS run, code, length(subject) % 5 = 0 AS resolved FROM issues",
) + f"""
SELECT run, count(*) FILTER ({SEVERITY} LIKE '%BLOCKER%' AND NOT resolved) AS blockers,
  count(*) FILTER ({SEVERITY} = 'REVIEW' AND NOT resolved) AS reviews,
  count(*) FILTER (NOT resolved) = 0 AS allowed
FROM runs GROUP BY run""")
def promotion_gate(t):
    rows = identity_issue_rows(t).select(
        F.substring_index("subject", "/", 1).alias("run"), "code", (F.length("subject") % 5 == 0).alias("resolved")
    )
    return issues.gate(rows, "run", "resolved")


@query("library_summary", with_(**BASE) + """
SELECT (SELECT count(*) FROM items) AS archive_count, (SELECT count(DISTINCT series_key) FROM items) AS series_count,
  (SELECT count(*) FROM (SELECT DISTINCT series_key, identity FROM items WHERE kind = 'volume')) AS fallback_count,
  (SELECT count(*) FROM (SELECT DISTINCT series_key, identity FROM items WHERE kind = 'special')) AS special_count,
  (SELECT count(*) FROM documents) AS page_count, (SELECT count(*) FROM labels) AS unaffected_checked""")
def library_summary(t):
    return identity.library_summary(items(t), t.documents, t.labels)


@query("tokens", with_(**BASE, tokens=TOKENS) + """
SELECT path, ch AS chapter, vol AS volume_value, hasvol AS has_volume, sp AS special FROM tokens""")
def tokens(t):
    stem = F.col("stem")
    return items(t).select(
        "path", ident.chapter_token(stem).alias("chapter"), ident.volume_token(stem).alias("volume_value"),
        ident.has_volume_token(stem).alias("has_volume"), ident.special_name_token(stem).alias("special"),
    )


@query("canonical_identity", with_(**BASE) + """
SELECT path, CASE WHEN is_special THEN 'special:' || coalesce(number, '') WHEN coalesce(number, '') <> '' THEN 'chapter:' || number
  ELSE 'volume:' || coalesce(volume, '') END AS label, number_id, volume_id, series_key FROM items""")
def canonical_identity(t):
    label = ident.canonical_identity(F.col("format"), F.col("number"), F.col("volume"))
    return items(t).select("path", label.alias("label"), "number_id", "volume_id", "series_key")


@query("output_name", with_(**BASE) + r"""
SELECT path, CASE
  WHEN kind = 'special' THEN 'S SP' || lpad(special, 2, '0') || ' ' || title || '.cbz'
  WHEN kind = 'volume' THEN 'S v' || CASE WHEN length(volume_id) < 2 THEN '0' ELSE '' END || volume_id || '.cbz'
  WHEN kind = 'chapter' AND policy = 'volume-aware-chapter' THEN
    'S Vol.' || CASE WHEN length(volume_id) < 2 THEN '0' ELSE '' END || volume_id || ' Ch.00' || number_id || '.cbz'
  WHEN kind = 'chapter' AND policy = 'continuous-chapter' THEN 'S Ch.00' || number_id || '.cbz' END AS output
FROM items""")
def output_name(t):
    named = F.coalesce("special", "number_id")
    name = ident.output_name(F.lit("S"), F.col("kind"), F.col("policy"), named, F.col("volume_id"), F.col("title"))
    return items(t).select("path", F.when(F.col("kind").isin("special", "volume", "chapter"), name).alias("output"))
