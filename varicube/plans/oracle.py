"""DuckDB statements that restate the registered queries."""

from __future__ import annotations

from varicube.domain import (
    DIMENSIONS,
    GENCODE_TERMS,
    REDUNDANT_GENESET_GENCODE,
    REDUNDANT_TYPE_GENCODE,
    REGION_FLAGS,
    SHIFT_GROUPS,
)
from varicube.functions import annotate, stats
from varicube.plans import star_tables as star

SCORE = star.SCORE_COLUMN


def _strings(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _any(words, column: str = "Consequence") -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _code_sql() -> str:
    """A category's number: the places of its terms in mixed radix."""
    code = "0::BIGINT"
    for name in DIMENSIONS:
        terms = star.DOMAIN.terms[name]
        code = f"(({code}) * {len(terms)} + list_position([{_strings(terms)}], {name}) - 1)"
    return f"CAST({code} AS BIGINT)"


VARIANTS = f"""
v AS (
  SELECT 'S' || CAST(o_custkey AS VARCHAR) AS "SAMPLE",
    'chr' || CAST(l_suppkey % 22 + 1 AS VARCHAR) AS "CHROM",
    CAST(floor(l_extendedprice) AS BIGINT) AS "POS",
    CASE WHEN l_quantity <= 25 OR l_linenumber % 2 = 0 THEN 'A' ELSE 'ACGT' END AS "REF",
    CASE WHEN l_quantity <= 25 THEN 'G' WHEN l_linenumber % 2 = 1 THEN 'A' ELSE 'ACC' END AS "ALT",
    ([{_strings(star.CONSEQUENCES)}])[(l_linenumber * 7 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) % {len(star.CONSEQUENCES)} + 1] AS "Consequence",
    'G' || CAST(l_partkey AS VARCHAR) AS "SYMBOL",
    'G' || CAST(l_suppkey AS VARCHAR) AS "NEAREST",
    CASE WHEN l_linestatus = 'F' THEN 'HC' ELSE 'LC' END AS "LoF",
    CASE l_returnflag WHEN 'A' THEN 'SINGLE_EXON' WHEN 'R' THEN 'PHYLOCSF_WEAK' ELSE '' END AS "LoF_flags",
    CASE WHEN l_linenumber = 7 THEN ''
         WHEN CAST(round_even(l_discount * 100, 0) AS INTEGER) = 0 THEN 'NA'
         WHEN l_linenumber % 2 = 1 THEN '1&' || CAST(CAST(round_even(l_discount * 100, 0) AS INTEGER) AS VARCHAR)
         ELSE CAST(CAST(round_even(l_discount * 100, 0) AS INTEGER) AS VARCHAR) END AS "{SCORE}",
    CAST((CASE WHEN l_tax >= 0.05 THEN 1 ELSE 0 END) + (CASE WHEN month(l_shipdate) <= 3 THEN 2 ELSE 0 END)
      + (CASE WHEN l_suppkey % 4 = 0 THEN 4 ELSE 0 END) AS BIGINT) AS "ANNOT"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

GENES = """
g AS (
  SELECT 'G' || CAST(p_partkey AS VARCHAR) AS gene_name,
    CAST(p_type IN ('ECONOMY','STANDARD','PROMO','MEDIUM') AS INTEGER) AS "ProteinCoding",
    CAST(p_type = 'SMALL' AS INTEGER) AS "lincRNA",
    CAST(p_size >= 40 AS INTEGER) AS "Constrained", p_retailprice
  FROM part
)"""

PEOPLE = """
people AS (
  SELECT 'S' || CAST(c_custkey AS VARCHAR) AS "SAMPLE",
    CASE WHEN c_mktsegment IN ('AUTOMOBILE','BUILDING') THEN 'case' ELSE 'ctrl' END AS "PHENOTYPE",
    'F' || CAST(c_custkey // 2 AS VARCHAR) AS "FAMILY",
    CAST(1 + floor(c_acctbal) / 10000 AS DECIMAL(12,4)) AS factor
  FROM customer WHERE c_custkey IN (SELECT o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
),
size AS (
  SELECT count(*) FILTER (WHERE "PHENOTYPE" = 'case') AS n_case, count(*) FILTER (WHERE "PHENOTYPE" = 'ctrl') AS n_ctrl FROM people
)"""

GENE_OF = f"""CASE WHEN {_any(annotate.INTERGENIC)} THEN "NEAREST" ELSE "SYMBOL" END"""
MAX_SCORE = f"""CASE WHEN "{SCORE}" NOT IN ('', 'NA') THEN list_max(list_transform(string_split("{SCORE}", '&'), lambda x: CAST(x AS DOUBLE))) END"""
GATE = """("LoF" = 'HC' AND "LoF_flags" IN ('SINGLE_EXON', ''))"""

_NONCODING = " ".join(f"WHEN {_any(words)} THEN ['NoncodingRegion', '{region}']" for region, words in annotate.NONCODING_ORDER)

TERMS = f"""{VARIANTS},{GENES},
a AS (
  SELECT v.*, coalesce(g."ProteinCoding", 0) = 1 AS pc, coalesce(g."lincRNA", 0) = 1 AS linc, coalesce(g."Constrained", 0) = 1 AS con,
    {MAX_SCORE} AS score
  FROM v LEFT JOIN g ON g.gene_name = {GENE_OF}
),
n AS (
  SELECT *, CASE {_NONCODING} WHEN pc THEN ['NoncodingRegion'] WHEN linc THEN ['NoncodingRegion', 'lincRnaRegion']
      ELSE ['NoncodingRegion', 'OtherTranscriptRegion'] END AS noncoding
  FROM a
),
t AS (
  SELECT *,
    ['All', CASE WHEN length("REF") = 1 AND length("ALT") = 1 THEN 'SNV' ELSE 'Indel' END] AS vt,
    list_concat(['Any'], list_filter([CASE WHEN pc THEN 'ProteinCoding' END, CASE WHEN con THEN 'Constrained' END], lambda x: x IS NOT NULL)) AS gs,
    list_concat(['All'], list_filter([CASE WHEN "ANNOT" & 1 = 1 THEN 'Conserved' END], lambda x: x IS NOT NULL)) AS fs,
    list_concat(['Any'], CASE WHEN NOT pc THEN noncoding
      WHEN {_any(annotate.TRUNCATING)} AND {GATE} THEN ['CodingRegion', 'PTVRegion']
      WHEN {_any(annotate.FRAMESHIFT)} AND {GATE} THEN ['CodingRegion', 'PTVRegion', 'FrameshiftRegion']
      WHEN {_any(annotate.MISSENSE)} THEN CASE WHEN score >= {star.SCORE_THRESHOLD}
        THEN ['CodingRegion', 'MissenseRegion', 'DamagingMissenseRegion'] ELSE ['CodingRegion', 'MissenseRegion'] END
      WHEN {_any(annotate.INFRAME)} THEN ['CodingRegion', 'InFrameRegion']
      WHEN {_any(annotate.SILENT)} THEN ['CodingRegion', 'SilentRegion']
      WHEN {_any(annotate.CODING_REMAINDER + annotate.TRUNCATING + annotate.FRAMESHIFT)} THEN ['CodingRegion']
      ELSE noncoding END) AS gc,
    list_concat(['Any'], list_filter([CASE WHEN "ANNOT" & 2 = 2 THEN 'Enhancer' END, CASE WHEN "ANNOT" & 4 = 4 THEN 'OpenChromatin' END], lambda x: x IS NOT NULL)) AS fa
  FROM n
)"""

REDUNDANT = "(" + " OR ".join(
    [f"(variant_type = '{a}' AND gencode = '{b}')" for a, b in REDUNDANT_TYPE_GENCODE]
    + [f"(gene_set = '{a}' AND gencode = '{b}')" for a, b in REDUNDANT_GENESET_GENCODE]
) + ")"

DIMS = ", ".join(DIMENSIONS)
KEY = " || '_' || ".join(DIMENSIONS)

# Explodes of the same SELECT would be zipped in DuckDB: one level per dimension gives their product.
CUBE = f"""{TERMS},
e1 AS (SELECT "SAMPLE", unnest(vt) AS variant_type, gs, fs, gc, fa FROM t),
e2 AS (SELECT "SAMPLE", variant_type, unnest(gs) AS gene_set, fs, gc, fa FROM e1),
e3 AS (SELECT "SAMPLE", variant_type, gene_set, unnest(gc) AS gencode, fs, fa FROM e2),
e4 AS (SELECT "SAMPLE", variant_type, gene_set, gencode, unnest(fs) AS functional_score, fa FROM e3 WHERE NOT {REDUNDANT}),
e5 AS (SELECT "SAMPLE", variant_type, gene_set, gencode, functional_score, unnest(fa) AS functional_annotation FROM e4),
counts AS MATERIALIZED (
  SELECT "SAMPLE", {DIMS}, {KEY} AS "Category", count(*) AS n FROM e5 GROUP BY ALL
),
raw AS MATERIALIZED (SELECT "Category", {DIMS}, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL)"""

OPEN_CUBE = CUBE.split("counts AS")[0].replace(f" WHERE NOT {REDUNDANT}", "") + f"""
opened AS (SELECT {DIMS}, count(*) AS n FROM e5 GROUP BY ALL)"""

BURDEN = f"""{CUBE},{PEOPLE},
burden AS (
  SELECT "Category", {DIMS}, n_case, n_ctrl,
    CAST(sum(CASE WHEN "PHENOTYPE" = 'case' THEN n ELSE 0 END) AS BIGINT) AS case_n,
    CAST(sum(CASE WHEN "PHENOTYPE" = 'ctrl' THEN n ELSE 0 END) AS BIGINT) AS ctrl_n,
    count(*) FILTER (WHERE "PHENOTYPE" = 'case') AS case_c,
    count(*) FILTER (WHERE "PHENOTYPE" = 'ctrl') AS ctrl_c,
    sum(CASE WHEN "PHENOTYPE" = 'case' THEN n * factor ELSE 0 END)::DOUBLE AS case_a,
    sum(CASE WHEN "PHENOTYPE" = 'ctrl' THEN n * factor ELSE 0 END)::DOUBLE AS ctrl_a
  FROM counts JOIN people USING ("SAMPLE") CROSS JOIN size GROUP BY ALL
)"""


def _rr(case: str, ctrl: str) -> str:
    case, ctrl = f"({case})::DOUBLE", f"({ctrl})::DOUBLE"
    return (
        f"CASE WHEN {ctrl} <> 0 THEN ({case} / n_case) / ({ctrl} / n_ctrl) "
        f"WHEN {case} > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END"
    )


def _tails(pairs: str, name: str) -> str:
    """Exact two-sided P of (x, m) pairs and one-sided P with a pseudocount on both arms."""

    def log_mass(k: str, m: str) -> str:
        return (
            f"lgamma({m} + 1) - lgamma({k} + 1) - lgamma({m} - {k} + 1) + {k} * ln(n_case / (n_case + n_ctrl)::DOUBLE) "
            f"+ ({m} - {k}) * ln(n_ctrl / (n_case + n_ctrl)::DOUBLE)"
        )

    return f"""
{name}_pairs AS MATERIALIZED (SELECT DISTINCT x, m FROM ({pairs})),
{name}_mass AS (
  SELECT x, m, k, exp({log_mass('k', 'm')}) AS mass, exp({log_mass('x', 'm')}) AS seen, n_case / (n_case + n_ctrl)::DOUBLE AS p
  FROM (SELECT x, m, unnest(range(m + 1)) AS k FROM {name}_pairs) CROSS JOIN size
),
{name}_two AS MATERIALIZED (
  SELECT x, m, CASE WHEN m = 0 OR x = any_value(p) * m THEN 1.0
    ELSE least(1.0, sum(mass) FILTER (WHERE mass <= seen * (1 + 1e-7))) END AS p_two
  FROM {name}_mass GROUP BY x, m
),
{name}_one AS MATERIALIZED (
  SELECT x, m, least(1.0, sum(exp({log_mass('k', '(m + 2)')})) FILTER (WHERE k >= x + 1)) AS p_one
  FROM (SELECT x, m, unnest(range(m + 3)) AS k FROM {name}_pairs) CROSS JOIN size GROUP BY x, m
)"""


def _horner(coefficients, x: str) -> str:
    value = f"{coefficients[-1]!r}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        value = f"({value} * {x} + {c!r}::DOUBLE)"
    return value


def _quantile(p: str) -> str:
    """Normal quantile from the same published coefficients."""
    q = f"({p} - 0.5::DOUBLE)"
    r = f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1::DOUBLE - {p} END))"
    s = f"(0.180625::DOUBLE - {q} * {q})"
    middle, far = f"({r} - 1.6::DOUBLE)", f"({r} - 5::DOUBLE)"

    def ratio(table, x):
        return f"({_horner(table[0], x)} / {_horner(table[1], x)})"

    return f"""CASE WHEN {p} = 0 THEN '-inf'::DOUBLE WHEN {p} = 1 THEN 'inf'::DOUBLE
      WHEN abs({q}) <= 0.425 THEN {q} * {ratio(stats.AS241_CENTRE, s)}
      ELSE (CASE WHEN {q} < 0 THEN -1 ELSE 1 END) * (CASE WHEN {r} <= 5 THEN {ratio(stats.AS241_MIDDLE, middle)} ELSE {ratio(stats.AS241_TAIL, far)} END) END"""


TESTED = f"""{BURDEN},{_tails('SELECT case_n AS x, case_n + ctrl_n AS m FROM burden', 'b')},
tested AS MATERIALIZED (
  SELECT burden.*, p_two AS "P", p_one AS "P_1side", {_rr('case_n', 'ctrl_n')} AS rr
  FROM burden JOIN b_two ON b_two.x = case_n AND b_two.m = case_n + ctrl_n JOIN b_one ON b_one.x = case_n AND b_one.m = case_n + ctrl_n
)"""

# Smallest m with m p^(m-1) (1-p) + p^m < 0.05.
THRESHOLD = """(SELECT min(m) FROM (SELECT unnest(range(1, 100000)) AS m), size
  WHERE m * pow(n_case / (n_case + n_ctrl)::DOUBLE, m - 1) * (1 - n_case / (n_case + n_ctrl)::DOUBLE) + pow(n_case / (n_case + n_ctrl)::DOUBLE, m) < 0.05)"""

TRACKS = f"""
ev AS (
  SELECT 'chr' || CAST(user_id % 22 + 1 AS VARCHAR) AS chrom,
    CAST(floor((epoch(date_trunc('second', ts)) - 1704067200) / 60) AS BIGINT) AS s,
    CAST(floor(value) AS BIGINT) + 1 AS len,
    list_position([{_strings(star.EVENT_TRACKS)}], event_type) - 1 AS track
  FROM events
),
iv AS (SELECT chrom, s AS "start", s + len AS "end", CAST(track AS INTEGER) AS track FROM ev WHERE track IS NOT NULL AND track >= 0)"""

SEGMENTS = f"""{TRACKS},
pts AS (SELECT DISTINCT chrom, pos FROM (SELECT chrom, "start" AS pos FROM iv UNION ALL SELECT chrom, "end" FROM iv)),
slices AS (SELECT chrom, pos AS s, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS e FROM pts),
seg AS MATERIALIZED (
  SELECT slices.chrom, s AS "start", e AS "end", CAST(bit_or(1::BIGINT << track) AS BIGINT) AS mask
  FROM slices JOIN iv ON iv.chrom = slices.chrom AND iv."start" < e AND s < iv."end" WHERE e IS NOT NULL GROUP BY ALL
)"""

REGIONS = """
vr AS (
  SELECT *, CASE WHEN length("REF") > 1 THEN "POS" ELSE "POS" - 1 END AS r_start,
    CASE WHEN length("REF") > 1 THEN "POS" + length("REF") - 1 WHEN length("ALT") > 1 THEN "POS" + 1 ELSE "POS" END AS r_end
  FROM v
),
masks AS MATERIALIZED (
  SELECT d.chrom, r_start, r_end, CAST(bit_or(mask) AS BIGINT) AS mask
  FROM (SELECT DISTINCT "CHROM" AS chrom, r_start, r_end FROM vr) d JOIN seg ON seg.chrom = d.chrom AND seg."start" < r_end AND r_start < seg."end"
  GROUP BY ALL
)"""

PAIRS_VARIANT = f"""{TERMS},
sig AS MATERIALIZED (SELECT vt, gs, fs, gc, fa, count(*) AS w, row_number() OVER () AS id FROM t GROUP BY ALL),
s1 AS (SELECT id, w, unnest(vt) AS variant_type, gs, fs, gc, fa FROM sig),
s2 AS (SELECT id, w, variant_type, unnest(gs) AS gene_set, fs, gc, fa FROM s1),
s3 AS (SELECT id, w, variant_type, gene_set, unnest(gc) AS gencode, fs, fa FROM s2),
s4 AS (SELECT id, w, variant_type, gene_set, gencode, unnest(fs) AS functional_score, fa FROM s3 WHERE NOT {REDUNDANT}),
s5 AS (SELECT id, w, variant_type, gene_set, gencode, functional_score, unnest(fa) AS functional_annotation FROM s4),
keyed AS MATERIALIZED (SELECT id, w, {KEY} AS c FROM s5),
pairs AS MATERIALIZED (SELECT a.c AS category_i, b.c AS category_j, CAST(sum(a.w) AS BIGINT) AS n FROM keyed a JOIN keyed b USING (id) GROUP BY ALL)"""

PAIRS_SAMPLE = f"""{CUBE},
keyed AS MATERIALIZED (SELECT "SAMPLE" AS id, "Category" AS c FROM counts),
pairs AS MATERIALIZED (SELECT a.c AS category_i, b.c AS category_j, count(*) AS n FROM keyed a JOIN keyed b USING (id) GROUP BY ALL)"""

CORR = """,
own AS (SELECT category_i AS c, n FROM pairs WHERE category_i = category_j),
corr AS MATERIALIZED (
  SELECT category_i, category_j, pairs.n, pairs.n / sqrt(x.n * y.n::DOUBLE) AS corr
  FROM pairs JOIN own x ON x.c = category_i JOIN own y ON y.c = category_j
)"""

GENCODE_POSITION = f"list_position([{_strings(GENCODE_TERMS)}], split_part(c, '_', 4))"

BLOCKS = f"""{PAIRS_SAMPLE}{CORR},
cl AS (SELECT DISTINCT c, CAST({GENCODE_POSITION} AS INTEGER) AS cluster FROM keyed),
sizes AS (SELECT cluster, count(*) AS size FROM cl GROUP BY 1),
blocks AS (
  SELECT a.cluster AS cluster_i, b.cluster AS cluster_j, sum(corr) / (any_value(x.size) * any_value(y.size)) AS mean_corr
  FROM corr JOIN cl a ON a.c = category_i JOIN cl b ON b.c = category_j JOIN sizes x ON x.cluster = a.cluster JOIN sizes y ON y.cluster = b.cluster
  WHERE a.cluster <= b.cluster GROUP BY 1, 2
)"""


def _labels(trials: int) -> str:
    return f"""
labels AS MATERIALIZED (
  SELECT trial, "SAMPLE", row_number() OVER (PARTITION BY trial ORDER BY md5(CAST(trial AS VARCHAR) || '|' || "SAMPLE"), "SAMPLE") <= n_case AS is_case
  FROM people CROSS JOIN (SELECT unnest(range(1, {trials + 1})) AS trial) CROSS JOIN size
)"""


def _permuted(trials: int, value: str = "n") -> str:
    """Label draws and permuted counts of every (trial, category)."""
    return f"""{_labels(trials)},
perm AS MATERIALIZED (
  SELECT trial, "Category", CAST(sum(CASE WHEN is_case THEN {value} ELSE 0 END) AS BIGINT) AS case_n,
    CAST(sum(CASE WHEN is_case THEN 0 ELSE {value} END) AS BIGINT) AS ctrl_n
  FROM counts JOIN labels USING ("SAMPLE") GROUP BY ALL
)"""


def _exceed(trials: int) -> str:
    return f"""(SELECT burden."Category", any_value({_rr('burden.case_n', 'burden.ctrl_n')}) AS rr,
      count(*) FILTER (WHERE NOT isnan(prr) AND ((rr0 >= 1 AND prr >= rr0) OR (rr0 < 1 AND prr <= rr0))) AS n_extreme
    FROM (SELECT burden.*, {_rr('burden.case_n', 'burden.ctrl_n')} AS rr0 FROM burden) burden
    JOIN (SELECT trial, "Category", {_rr('case_n', 'ctrl_n')} AS prr FROM perm CROSS JOIN size WHERE trial <= {trials}) p USING ("Category")
    GROUP BY 1)"""


_FLAG_SQL = {
    name: f"gencode IN ({_strings(members)})" + (" OR gene_set = 'lincRNA'" if name == "is_lincRNA" else "")
    for name, members in REGION_FLAGS.items()
}


def _set_list() -> str:
    parts = [f"CASE WHEN {test} THEN '{name}' END" for name, test in _FLAG_SQL.items()]
    for term, wild in (("gene_set", "Any"), ("functional_annotation", "Any"), ("functional_score", "All")):
        parts.append(f"CASE WHEN {term} <> '{wild}' THEN 'is_' || {term} END")
        for group in SHIFT_GROUPS:
            parts.append(f"CASE WHEN {term} <> '{wild}' AND ({_FLAG_SQL['is_' + group]}) THEN 'is_{group}_' || {term} END")
    parts.append("CASE WHEN functional_annotation <> 'Any' AND gene_set <> 'Any' THEN 'is_' || functional_annotation || '_' || gene_set END")
    parts.append("CASE WHEN functional_score <> 'All' AND gene_set <> 'Any' THEN 'is_' || functional_score || '_' || gene_set END")
    return f"list_distinct(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))"


SETS = f"""
sets AS MATERIALIZED (SELECT "Category", n, unnest({_set_list()}) AS category_set FROM raw)"""

SIGNED = f"""{TESTED},{_permuted(5)},{_tails('SELECT case_n AS x, case_n + ctrl_n AS m FROM perm', 's')},
signed AS MATERIALIZED (
  SELECT trial, "Category", CASE WHEN {_rr('case_n', 'ctrl_n')} < 1 THEN -p_two ELSE p_two END AS signed_p
  FROM perm CROSS JOIN size JOIN s_two ON s_two.x = case_n AND s_two.m = case_n + ctrl_n
)"""

SHIFT = f"""{SIGNED},{SETS},
members AS (SELECT "Category", category_set FROM sets WHERE n >= 7 UNION ALL SELECT "Category", 'All' FROM raw WHERE n >= 7),
observed AS (
  SELECT category_set, count(*) FILTER (WHERE "P" <= 0.05 AND rr > 1 AND NOT isnan(rr)) AS obs_case, count(*) FILTER (WHERE "P" <= 0.05 AND rr < 1) AS obs_ctrl
  FROM members JOIN tested USING ("Category") GROUP BY 1
),
by_trial AS (
  SELECT category_set, trial, count(*) FILTER (WHERE signed_p > 0 AND signed_p <= 0.05) AS c, count(*) FILTER (WHERE signed_p < 0 AND -signed_p <= 0.05) AS d
  FROM members JOIN signed USING ("Category") GROUP BY 1, 2
),
shift AS MATERIALIZED (
  SELECT category_set, obs_case AS "N_cats_case", obs_ctrl AS "N_cats_control",
    count(*) FILTER (WHERE c >= obs_case) / 5.0::DOUBLE AS "P_case", count(*) FILTER (WHERE d >= obs_ctrl) / 5.0::DOUBLE AS "P_control"
  FROM observed JOIN by_trial USING (category_set) GROUP BY ALL
)"""


def _flag_exprs() -> str:
    return ", ".join(f"CAST(({test}) AS INTEGER) AS \"{name}\"" for name, test in _FLAG_SQL.items())


ROW = '"SAMPLE", "CHROM", "POS", "REF", "ALT", "Consequence"'


def _sorted(array: str) -> str:
    return f"array_to_string(list_sort({array}), ',')"


def _extract_sql() -> str:
    """The extract flags level by level, each from the ones before."""
    words = annotate
    coding = words.TRUNCATING + words.FRAMESHIFT + words.MISSENSE + words.INFRAME + words.SILENT + words.CODING_REMAINDER
    return f"""WITH {TERMS},
x1 AS (SELECT *, pc AND {_any(coding)} AS f_coding FROM t),
x2 AS (SELECT *, f_coding AND {_any(words.TRUNCATING + words.FRAMESHIFT)} AND {GATE} AS f_ptv,
  NOT f_coding AND contains("Consequence", '3_prime_UTR_variant') AS f_u3, NOT f_coding AND contains("Consequence", '5_prime_UTR_variant') AS f_u5 FROM x1),
x3 AS (SELECT *, f_coding AND NOT f_ptv AND {_any(words.MISSENSE)} AS f_mis, f_coding OR f_u3 OR f_u5 AS k1 FROM x2),
x4 AS (SELECT *, f_coding AND NOT f_ptv AND NOT f_mis AND {_any(words.INFRAME)} AS f_in, NOT k1 AND contains("Consequence", 'upstream_gene_variant') AS f_prom FROM x3),
x5 AS (SELECT *, f_coding AND NOT f_ptv AND NOT f_mis AND NOT f_in AND {_any(words.SILENT)} AS f_sil,
  NOT k1 AND NOT f_prom AND contains("Consequence", 'splice_region_variant') AS f_spl FROM x4),
x6 AS (SELECT *, NOT k1 AND NOT f_prom AND NOT f_spl AND contains("Consequence", 'intron_variant') AS f_int FROM x5),
x7 AS (SELECT *, NOT k1 AND NOT f_prom AND NOT f_spl AND NOT f_int AND {_any(words.INTERGENIC)} AS f_gen FROM x6),
x8 AS (SELECT *, NOT (k1 OR f_prom OR f_spl OR f_int OR f_gen) AS rest FROM x7)
SELECT {ROW}, CAST(f_coding AS INTEGER) AS "is_CodingRegion", CAST(NOT f_coding AS INTEGER) AS "is_NoncodingRegion",
  CAST(f_ptv AS INTEGER) AS "is_PTVRegion",
  CAST(f_ptv AND contains("Consequence", 'frameshift_variant') AND NOT {_any(words.TRUNCATING)} AS INTEGER) AS "is_FrameshiftRegion",
  CAST(f_mis AS INTEGER) AS "is_MissenseRegion", CAST(f_mis AND coalesce(score >= {star.SCORE_THRESHOLD}, false) AS INTEGER) AS "is_DamagingMissenseRegion",
  CAST(f_in AS INTEGER) AS "is_InFrameRegion", CAST(f_sil AS INTEGER) AS "is_SilentRegion",
  CAST(f_u3 AS INTEGER) AS "is_3PrimeUTRsRegion", CAST(f_u5 AS INTEGER) AS "is_5PrimeUTRsRegion", CAST(f_u3 OR f_u5 AS INTEGER) AS "is_UTRsRegion",
  CAST(f_prom AS INTEGER) AS "is_PromoterRegion", CAST(f_spl AS INTEGER) AS "is_SpliceSiteRegion", CAST(f_int AS INTEGER) AS "is_IntronRegion",
  CAST(f_gen AS INTEGER) AS "is_IntergenicRegion", CAST(rest AND linc AND NOT pc AS INTEGER) AS "is_lincRnaRegion",
  CAST(rest AND NOT linc AND NOT pc AS INTEGER) AS "is_OtherTranscriptRegion"
FROM x8"""


def _r6(expression: str, name: str) -> str:
    return f'round(CAST({expression} AS DOUBLE), 6) AS "{name}"'


_Z_ALL = f"""{TESTED},
zz AS (SELECT *, CASE WHEN rr <= 1 AND NOT isnan(rr) AND "P" < 0.5 THEN 1 - round("P", 9) ELSE round("P", 9) END AS dp FROM tested),
zq AS (SELECT *, {_quantile('(1::DOUBLE - dp)')} AS z0 FROM zz),
zt AS (SELECT max(z0) FILTER (WHERE NOT isinf(z0)) AS top FROM zq),
members AS (
  SELECT "Category", gencode, case_n + ctrl_n AS raw_n, rr,
    CASE WHEN isinf(z0) THEN sign(z0) * 1.1 * abs(top) ELSE z0 END AS z,
    CASE WHEN rr = 0 THEN '-inf'::DOUBLE ELSE ln(rr) END AS log_rr,
    case_n + ctrl_n < 20 AS flag
  FROM zq CROSS JOIN zt
)"""

_GENCODE_OF = """
go AS (SELECT length("REF") = 1 AND length("ALT") = 1 AS snv, unnest(gc) AS gencode, gs[-1] AS gene_set FROM t)"""



def _grid_sql() -> str:
    """The models of the annotation grid over all categories, with their rare categories and training samples."""
    dims = ("gene_set", "functional_score", "functional_annotation")
    asked = [(d, t) for d in dims for t in star.DOMAIN.terms[d][1:]]
    rows = [("NULL::VARCHAR", "NULL::VARCHAR", "'whole'", "true")]
    rows += [(f"'{d}'", f"'{t}'", f"'{mode}'", f"{d} {sign} '{t}'") for mode, sign in (("each", "="), ("without", "<>")) for d, t in asked]
    selects = " UNION ALL ".join(
        f"SELECT 'all' AS domain, {d} AS dimension, {t} AS term, {m} AS mode, count(*) FILTER (WHERE {rule}) AS n_rare FROM burden WHERE ctrl_n < n_ctrl // 10"
        for d, t, m, rule in rows
    )
    train = """(SELECT CAST(sum(round_even(c * 0.7::DOUBLE, 0)) AS BIGINT) FROM (SELECT count(*) AS c FROM people GROUP BY "PHENOTYPE"))"""
    return f"WITH {BURDEN} SELECT *, true AS same_rare, {train} AS n_train, true AS optimal FROM ({selects})"


ORACLE: dict[str, str] = {
    "lasso_grid_optimality": _grid_sql(),
    "scan_samples": f'WITH {PEOPLE} SELECT "SAMPLE", "PHENOTYPE", "FAMILY" FROM people',
    "info_parse_kv": f"""WITH {VARIANTS} SELECT "POS", "Consequence", "SAMPLE" AS info_sample, 'SYM=' || "SYMBOL" AS info_rule, "ANNOT" AS info_annot, 1 AS has_db FROM v""",
    "csq_positional_split": f"""WITH {VARIANTS} SELECT "SAMPLE", "POS", "Consequence", "SYMBOL", "NEAREST", "LoF", "LoF_flags", "{SCORE}" FROM v""",
    "gene_matrix_sets": f"""WITH {GENES} SELECT gene_name, array_to_string(list_filter([CASE WHEN "Constrained" = 1 THEN 'Constrained' END, CASE WHEN "ProteinCoding" = 1 THEN 'ProteinCoding' END, CASE WHEN "lincRNA" = 1 THEN 'lincRNA' END], lambda x: x IS NOT NULL), ',') AS gene_sets FROM g""",
    "gene_keep_last": """SELECT p_name AS gene_name, p_partkey AS gene_id, p_type, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) = 1""",
    "mask_bits": f"""WITH {VARIANTS} SELECT "SAMPLE", "POS", "ANNOT", CAST("ANNOT" & 1 AS INTEGER) AS "Conserved", CAST("ANNOT" >> 1 & 1 AS INTEGER) AS "Enhancer", CAST("ANNOT" >> 2 & 1 AS INTEGER) AS "OpenChromatin" FROM v""",
    "variant_type": f"""WITH {VARIANTS} SELECT {ROW}, CASE WHEN length("REF") = 1 AND length("ALT") = 1 THEN 'SNV' ELSE 'Indel' END AS variant_type FROM v""",
    "variant_class": f"""WITH {VARIANTS} SELECT {ROW}, CASE WHEN length("REF") > 1 THEN 'Deletion' WHEN length("ALT") = 1 THEN 'SNV' ELSE 'Insertion' END AS class FROM v""",
    "effective_gene": f"""WITH {VARIANTS} SELECT {ROW}, {GENE_OF} AS gene FROM v""",
    "gene_left_join": f"""WITH {VARIANTS},{GENES} SELECT {ROW}, coalesce("ProteinCoding", 0) AS "ProteinCoding", coalesce("lincRNA", 0) AS "lincRNA", coalesce("Constrained", 0) AS "Constrained" FROM v LEFT JOIN g k ON k.gene_name = {GENE_OF} || CASE WHEN "POS" % 3 = 0 THEN '.1' ELSE '' END""",
    "gene_set_terms": f"""WITH {TERMS} SELECT {ROW}, {_sorted('gs')} AS gene_set FROM t""",
    "gencode_cascade": f"""WITH {TERMS} SELECT {ROW}, "LoF", "LoF_flags", "{SCORE}", {_sorted('gc')} AS gencode FROM t""",
    "damaging_missense": f"""WITH {VARIANTS} SELECT {ROW}, "{SCORE}", {MAX_SCORE} AS score, CAST(coalesce(({MAX_SCORE}) >= {star.SCORE_THRESHOLD}, false) AS INTEGER) AS damaging FROM v""",
    "track_terms": f"""WITH {TERMS} SELECT {ROW}, "ANNOT", {_sorted('fs')} AS functional_score, {_sorted('fa')} AS functional_annotation FROM t""",
    "category_keys": f"""WITH {CUBE} SELECT "Category", {DIMS} FROM raw""",
    "region_flag_table": f"""WITH {CUBE} SELECT "Category", {DIMS}, {_flag_exprs()} FROM raw""",
    "extract_region_flags": _extract_sql(),
    "redundant_exclusion": f"""WITH {OPEN_CUBE} SELECT * FROM opened WHERE NOT {REDUNDANT}""",
    "redundant_rule_table": f"""WITH {OPEN_CUBE} SELECT * FROM opened WHERE NOT {REDUNDANT}""",
    "count_threshold": f"""WITH {CUBE} SELECT "Category", n AS "Raw_counts" FROM raw WHERE n >= 100""",
    "auto_threshold": f"""WITH {CUBE},{PEOPLE} SELECT "Category", n AS "Raw_counts", CAST({THRESHOLD} AS BIGINT) AS threshold FROM raw WHERE n >= {THRESHOLD}""",
    "rare_categories": f"""WITH {BURDEN} SELECT "Category", ctrl_n AS ctrl_count FROM burden WHERE ctrl_n < 50""",
    "significant_categories": f"""WITH {TESTED} SELECT "Category", CASE WHEN rr > 1 THEN 'case' ELSE 'ctrl' END AS direction, {_r6('"P"', 'P')} FROM tested WHERE "P" <= 0.05 AND rr <> 1""",
    "category_set_extract": f"""WITH {CUBE},
f1 AS (SELECT "CHROM", "POS", "REF", "ALT", "SAMPLE", unnest(vt) AS variant_type, gs, fs, gc, fa FROM t),
f2 AS (SELECT * EXCLUDE (gs), unnest(gs) AS gene_set FROM f1), f3 AS (SELECT * EXCLUDE (gc), unnest(gc) AS gencode FROM f2),
f4 AS (SELECT * EXCLUDE (fs), unnest(fs) AS functional_score FROM f3), f5 AS (SELECT * EXCLUDE (fa), unnest(fa) AS functional_annotation FROM f4)
SELECT "CHROM", "POS", "REF", "ALT", "SAMPLE", {KEY} AS "CATEGORY" FROM f5 WHERE {KEY} IN (SELECT "Category" FROM raw WHERE n <= 40)""",
    "bed_merge": f"""WITH {SEGMENTS} SELECT * FROM seg""",
    "interval_overlap_or": f"""WITH {VARIANTS},{SEGMENTS},{REGIONS} SELECT * FROM masks""",
    "interval_overlap_left0": f"""WITH {VARIANTS},{SEGMENTS},{REGIONS} SELECT "SAMPLE", vr."CHROM", "POS", "REF", "ALT", coalesce(mask, 0) AS "ANNOT" FROM vr LEFT JOIN masks ON masks.chrom = vr."CHROM" AND masks.r_start = vr.r_start AND masks.r_end = vr.r_end""",
    "contig_filter": f"""WITH {TRACKS} SELECT * FROM iv WHERE chrom = 'chr7'""",
    "phenotype_join": f"""WITH {BURDEN} SELECT "SAMPLE", "PHENOTYPE", CAST(sum(n) AS BIGINT) AS n, count(*) AS n_categories FROM counts JOIN people USING ("SAMPLE") GROUP BY 1, 2""",
    "adjusted_counts": f"""WITH {BURDEN} SELECT "SAMPLE", "Category", n, {_r6('n * factor', 'adjusted')} FROM counts JOIN people USING ("SAMPLE")""",
    "semi_categories": f"""WITH {CUBE} SELECT "Category", count(*) AS n_samples, max(n) AS max_n FROM counts WHERE "Category" IN (SELECT "Category" FROM raw WHERE n >= 500) GROUP BY 1""",
    "sample_set_equality": f"""WITH {VARIANTS}, l AS (SELECT DISTINCT "SAMPLE" FROM v), r AS (SELECT DISTINCT 'S' || CAST(c_custkey AS VARCHAR) AS "SAMPLE" FROM customer)
SELECT "SAMPLE", 'left' AS side FROM l WHERE "SAMPLE" NOT IN (SELECT "SAMPLE" FROM r) UNION ALL SELECT "SAMPLE", 'right' FROM r WHERE "SAMPLE" NOT IN (SELECT "SAMPLE" FROM l)""",
    "cooccur_variant": f"""WITH {PAIRS_VARIANT} SELECT * FROM pairs""",
    "cooccur_sample": f"""WITH {PAIRS_SAMPLE} SELECT * FROM pairs""",
    "setname_match": f"""WITH {CUBE},{SETS} SELECT DISTINCT category_set FROM sets WHERE list_sort(string_split(replace(category_set, 'is_', ''), '_')) IN (['Enhancer', 'coding'], ['Constrained', 'OpenChromatin'])""",
    "category_counts": f"""WITH {CUBE} SELECT "SAMPLE", {DIMS}, n FROM counts""",
    "category_matrix_dense": f"""WITH {CUBE} SELECT s."SAMPLE", string_agg(CAST(coalesce(c.n, 0) AS VARCHAR), ',' ORDER BY raw."Category") AS counts FROM (SELECT DISTINCT "SAMPLE" FROM counts) s CROSS JOIN raw LEFT JOIN counts c ON c."SAMPLE" = s."SAMPLE" AND c."Category" = raw."Category" GROUP BY 1""",
    "cohort_sizes": f"""WITH {PEOPLE} SELECT n_case, n_ctrl FROM size""",
    "case_ctrl_counts": f"""WITH {BURDEN} SELECT "Category", case_n AS "Case_DNV_Count", ctrl_n AS "Ctrl_DNV_Count" FROM burden""",
    "carrier_counts": f"""WITH {BURDEN} SELECT "Category", case_c AS "Case_Carrier_Count", ctrl_c AS "Ctrl_Carrier_Count" FROM burden""",
    "raw_adj_counts": f"""WITH {BURDEN} SELECT "Category", case_n + ctrl_n AS "Raw_counts", {_r6('case_a + ctrl_a', 'Adj_counts')} FROM burden""",
    "burden_relative_risk": f"""WITH {BURDEN} SELECT "Category", {DIMS}, case_n AS "Case_DNV_Count", ctrl_n AS "Ctrl_DNV_Count", {_r6(_rr('case_n', 'ctrl_n'), 'Relative_Risk')} FROM burden""",
    "carrier_relative_risk": f"""WITH {BURDEN} SELECT "Category", case_c AS "Case_Carrier_Count", ctrl_c AS "Ctrl_Carrier_Count", {_r6(_rr('case_c', 'ctrl_c'), 'Relative_Risk')} FROM burden""",
    "adjusted_relative_risk": f"""WITH {BURDEN} SELECT "Category", {_r6('case_a', 'Case_DNV_Count')}, {_r6('ctrl_a', 'Ctrl_DNV_Count')}, {_r6(_rr('case_a', 'ctrl_a'), 'Relative_Risk')} FROM burden""",
    "category_universe": f"""WITH {CUBE} SELECT "Category", {DIMS} FROM raw""",
    "cluster_sizes": f"""WITH {_Z_ALL} SELECT CAST(list_position([{_strings(GENCODE_TERMS)}], gencode) AS INTEGER) AS cluster, count(*) FILTER (WHERE NOT flag) AS size FROM members GROUP BY 1""",
    "block_mean": f"""WITH {BLOCKS} SELECT cluster_i, cluster_j, {_r6('mean_corr', 'mean_corr')} FROM blocks""",
    "cluster_graph_edges": f"""WITH {BLOCKS} SELECT cluster_i AS src, cluster_j AS dst, {_r6('mean_corr', 'weight')} FROM blocks WHERE cluster_i < cluster_j AND mean_corr > 0.12""",
    "token_mode": f"""WITH {CUBE}, tk AS (SELECT CAST(list_position([{_strings(GENCODE_TERMS)}], gencode) AS INTEGER) AS cluster, unnest(string_split("Category", '_')) AS term FROM raw),
tc AS (SELECT cluster, term, count(*) AS n FROM tk WHERE term NOT IN ('All', 'Any', 'SNV', 'Indel') GROUP BY 1, 2), tm AS (SELECT cluster, max(n) AS n FROM tc GROUP BY 1)
SELECT cluster, n, CASE WHEN n > 1 THEN string_agg(term, '&' ORDER BY term) ELSE '' END AS terms FROM tc JOIN tm USING (cluster, n) GROUP BY 1, 2""",
    "cum_share_99": f"""WITH {CUBE}, code AS (SELECT raw."Category", raw.n,
  ((((list_position(['All','SNV','Indel'], variant_type) * 10 + list_position(['Any','ProteinCoding','lincRNA','Constrained'], gene_set)) * 10 + list_position(['All','Conserved'], functional_score)) * 100 + list_position([{_strings(GENCODE_TERMS)}], gencode)) * 10 + list_position(['Any','Enhancer','OpenChromatin'], functional_annotation)) AS ord FROM raw),
r AS (SELECT "Category", n, row_number() OVER w AS position, sum(n) OVER w AS s, sum(n) OVER () AS total FROM code WINDOW w AS (ORDER BY n DESC, ord ROWS UNBOUNDED PRECEDING))
SELECT "Category", n, position, {_r6('s / total::DOUBLE', 'share')} FROM r WHERE (s - n) / total::DOUBLE < 0.99""",
    "local_fdr": f"""WITH {TESTED}, o AS (SELECT "Category", round("P_1side", 6) AS post,
  ((((list_position(['All','SNV','Indel'], variant_type) * 10 + list_position(['Any','ProteinCoding','lincRNA','Constrained'], gene_set)) * 10 + list_position(['All','Conserved'], functional_score)) * 100 + list_position([{_strings(GENCODE_TERMS)}], gencode)) * 10 + list_position(['Any','Enhancer','OpenChromatin'], functional_annotation)) AS ord FROM tested)
SELECT "Category", {_r6('avg(post) OVER (ORDER BY post, ord ROWS UNBOUNDED PRECEDING)', 'local_fdr')} FROM o""",
    "bh_fdr": f"""WITH {TESTED}, o AS (SELECT "Category", round("P", 6) AS p FROM tested), r AS (SELECT *, p * count(*) OVER () / rank() OVER w AS lo, p * count(*) OVER () / (rank() OVER w + count(*) OVER (PARTITION BY p) - 1) AS q FROM o WINDOW w AS (ORDER BY p))
SELECT "Category", p AS "P", {_r6('least(1.0, min(q) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING))', 'FDR')} FROM r""",
    "version_sorted_variants": f"""WITH {VARIANTS}, s AS (SELECT DISTINCT "CHROM", "POS" FROM v) SELECT "CHROM", "POS", row_number() OVER (ORDER BY CAST(substr("CHROM", 4) AS INTEGER), "CHROM", "POS") - 1 AS ordinal FROM s""",
    "category_intersect": f"""WITH {TERMS},{_GENCODE_OF} SELECT gencode, gene_set FROM go WHERE snv INTERSECT SELECT gencode, gene_set FROM go WHERE NOT snv""",
    "category_except": f"""WITH {TERMS},{_GENCODE_OF} SELECT DISTINCT gencode, gene_set FROM go WHERE snv AND gene_set <> 'Any'""",
    "category_union": f"""WITH {TERMS},{_GENCODE_OF} SELECT DISTINCT gencode, gene_set FROM go""",
    "binomial_burden": f"""WITH {TESTED} SELECT "Category", {_r6('"P"', 'P')}, {_r6('"P_1side"', 'P_1side')}, {_r6(_quantile('(1::DOUBLE - "P_1side")'), 'Z_1side')} FROM tested""",
    "binomial_burden_adjusted": f"""WITH {BURDEN}, rb AS (SELECT "Category", CAST(round_even(case_a, 0) AS BIGINT) AS n1, CAST(round_even(ctrl_a, 0) AS BIGINT) AS n2 FROM burden),{_tails('SELECT n1 AS x, n1 + n2 AS m FROM rb', 'b')}
SELECT "Category", n1, n2, {_r6('p_two', 'P')} FROM rb JOIN b_two ON x = n1 AND m = n1 + n2""",
    "volcano_points": f"""WITH {TESTED}, k AS (SELECT *, CASE WHEN rr = 0 THEN '-inf'::DOUBLE ELSE log2(rr) END AS l FROM tested WHERE case_n + ctrl_n >= {THRESHOLD}),
edge AS (SELECT trunc(max(abs(l)) FILTER (WHERE NOT isinf(l) AND NOT isnan(l))) + 2 AS e FROM k)
SELECT "Category", {_r6('CASE WHEN isinf(l) THEN sign(l) * e ELSE l END', 'x')}, {_r6('"P"', 'P')} FROM k CROSS JOIN edge""",
    "permutation_risk": f"""WITH {BURDEN},{_permuted(20)} SELECT trial, "Category", case_n, ctrl_n, {_r6(_rr('case_n', 'ctrl_n'), 'perm_rr')} FROM perm CROSS JOIN size""",
    "permutation_carriers": f"""WITH {BURDEN},{_permuted(20, '1')} SELECT trial, "Category", case_n, ctrl_n FROM perm""",
    "permutation_pvalue": f"""WITH {BURDEN},{_permuted(20)} SELECT "Category", n_extreme, CASE WHEN NOT isnan(rr) THEN {'round((n_extreme + 1) / 21.0::DOUBLE, 6)'} END AS "P" FROM {_exceed(20)}""",
    "permutation_two_stage": f"""WITH {BURDEN},{_permuted(60)}, one AS (SELECT * FROM {_exceed(20)}), two AS (SELECT * FROM {_exceed(60)})
SELECT one."Category", CASE WHEN (one.n_extreme + 1) / 21.0::DOUBLE < 0.1 AND NOT isnan(one.rr) THEN two.n_extreme ELSE one.n_extreme END AS n_extreme,
  CAST(CASE WHEN (one.n_extreme + 1) / 21.0::DOUBLE < 0.1 AND NOT isnan(one.rr) THEN 60 ELSE 20 END AS INTEGER) AS n_trials,
  CASE WHEN NOT isnan(one.rr) THEN round(CASE WHEN (one.n_extreme + 1) / 21.0::DOUBLE < 0.1 THEN (two.n_extreme + 1) / 61.0::DOUBLE ELSE (one.n_extreme + 1) / 21.0::DOUBLE END, 6) END AS "P"
FROM one JOIN two USING ("Category")""",
    "permutation_signed_binomial": f"""WITH {SIGNED} SELECT trial, "Category", {_r6('signed_p', 'signed_p')} FROM signed""",
    "category_set_sizes": f"""WITH {CUBE},{SETS} SELECT category_set, count(*) AS n_categories FROM sets GROUP BY 1""",
    "burden_shift": f"""WITH {SHIFT} SELECT category_set, "N_cats_case", "N_cats_control", {_r6('"P_case"', 'P_case')}, {_r6('"P_control"', 'P_control')} FROM shift""",
    "topn_sets": f"""WITH {SHIFT} SELECT category_set, "N_cats_case", {_r6('"P_case"', 'P_case')} FROM shift WHERE category_set NOT IN ('All', 'is_lincRNA_lincRNA') ORDER BY shift."P_case", shift."N_cats_case" DESC, category_set LIMIT 10""",
    "shift_size_classes": f"""WITH {SHIFT}, pt AS (SELECT category_set, 'Case' AS phenotype, "N_cats_case" AS n_cats FROM shift UNION ALL SELECT category_set, 'Control', "N_cats_control" FROM shift),
p2 AS (SELECT * FROM pt WHERE category_set NOT IN ('All', 'is_lincRNA_lincRNA')),
ed AS (SELECT min(n_cats) AS lo, max(n_cats) AS hi, greatest(1, (max(n_cats) - min(n_cats)) // (CASE WHEN max(n_cats) >= 12 THEN 6 WHEN max(n_cats) >= 6 THEN 3 WHEN max(n_cats) > 1 THEN 2 ELSE 1 END)) AS step FROM p2)
SELECT category_set, phenotype, n_cats, CAST(1 + 2 * len(list_filter(list_slice(range(lo, hi + 1, step), 1, 6), lambda x: x < n_cats)) AS INTEGER) AS size FROM p2 CROSS JOIN ed""",
    "train_test_split": f"""WITH {PEOPLE}, r AS (SELECT *, row_number() OVER (PARTITION BY "PHENOTYPE" ORDER BY md5('42|' || "SAMPLE"), "SAMPLE") AS k, count(*) OVER (PARTITION BY "PHENOTYPE") AS c FROM people)
SELECT "SAMPLE", "PHENOTYPE", CASE WHEN k <= round_even(c * 0.7::DOUBLE, 0) THEN 'training' ELSE 'test' END AS "SET" FROM r""",
    "family_label_swap": f"""WITH {PEOPLE}, ends AS (SELECT "FAMILY", min("PHENOTYPE") AS low, max("PHENOTYPE") AS high FROM people GROUP BY 1)
SELECT "SAMPLE", "FAMILY", "PHENOTYPE", CASE WHEN CAST('0x' || substr(md5('7:' || "FAMILY"), 1, 1) AS INTEGER) % 2 = 1 THEN CASE WHEN "PHENOTYPE" = low THEN high ELSE low END ELSE "PHENOTYPE" END AS swapped
FROM people JOIN ends USING ("FAMILY")""",
    "category_key_codes": f"""WITH {CUBE} SELECT "Category", {_code_sql()} AS code, {_code_sql()} AS code_by_terms, "Category" AS again FROM raw""",
    "bed_text_roundtrip": f"""WITH {TRACKS} SELECT chrom, start, "end", 'all' AS asked FROM iv UNION ALL SELECT chrom, start, "end", 'chr7' FROM iv WHERE chrom = 'chr7'""",
    "indexed_contig_scan": f"""WITH {TRACKS} SELECT chrom, start, "end", 'all' AS asked FROM iv UNION ALL SELECT chrom, start, "end", 'chr7' FROM iv WHERE chrom = 'chr7'""",
    "leiden_quality": f"""WITH {CUBE} SELECT count(*) AS n_categories, true AS connected, true AS modularity_agrees, true AS modular FROM raw""",
    "correlation_sample": f"""WITH {PAIRS_SAMPLE}{CORR} SELECT category_i, category_j, {_r6('corr', 'corr')} FROM corr""",
    "correlation_variant": f"""WITH {PAIRS_VARIANT}{CORR} SELECT category_i, category_j, {_r6('corr', 'corr')} FROM corr""",
    "covariance_inter": f"""WITH {PAIRS_VARIANT},{PEOPLE} SELECT category_i, category_j, {_r6('n * (n_case / (n_case + n_ctrl)::DOUBLE) * (n_ctrl / (n_case + n_ctrl)::DOUBLE)', 'value')} FROM pairs CROSS JOIN size""",
    "neg_laplacian": f"""WITH {PAIRS_VARIANT}{CORR}, deg AS (SELECT category_j AS c, sum(abs(corr)) AS d FROM corr GROUP BY 1)
SELECT category_i, category_j, {_r6('abs(corr) / sqrt(x.d * y.d)', 'value')} FROM corr JOIN deg x ON x.c = category_i JOIN deg y ON y.c = category_j""",
    "eigen_moments": f"""WITH {PAIRS_VARIANT}{CORR}, deg AS (SELECT category_j AS c, sum(abs(corr)) AS d FROM corr GROUP BY 1),
cell AS (SELECT category_i AS i, category_j AS j, abs(corr) / sqrt(x.d * y.d) AS value FROM corr JOIN deg x ON x.c = category_i JOIN deg y ON y.c = category_j)
SELECT count(DISTINCT i) AS n, {_r6('sum(CASE WHEN i = j THEN value ELSE 0 END)', 'trace')}, {_r6('sum(value * value)', 'frobenius')} FROM cell""",
    "z_transform": f"""WITH {_Z_ALL} SELECT "Category", {_r6('z', 'z')}, {_r6('log_rr', 'log_rr')}, CAST(flag AS INTEGER) AS flag, CAST(flag OR isinf(log_rr) AS INTEGER) AS flag2 FROM members""",
    "cluster_pairs": f"""WITH {CUBE}, k AS (SELECT DISTINCT CAST(list_position([{_strings(GENCODE_TERMS)}], gencode) AS INTEGER) AS cluster FROM raw) SELECT a.cluster AS src, b.cluster AS dst FROM k a JOIN k b ON a.cluster < b.cluster""",
}
