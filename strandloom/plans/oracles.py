"""The same results in DuckDB's SQL, written apart from the plans."""

from __future__ import annotations

from strandloom.functions.sequences import TAXONOMY_HINT

READS = """
b AS (SELECT event_id, CAST(floor(event_id / 2) AS BIGINT) AS p, event_id % 2 AS mate FROM events),
k AS (SELECT *, CASE WHEN p % 10 < 5 THEN p % 7 WHEN p % 10 < 9 THEN 1000 + p % 150 WHEN p % 40 < 20 THEN 100000 + p ELSE 200000 + CAST(floor(p / 20) AS BIGINT) END AS vkey FROM b),
f AS (SELECT *, translate(concat(md5(concat('a', vkey)), md5(concat('b', vkey)), md5(concat('c', vkey)), md5(concat('d', vkey)), md5(concat('e', vkey))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS frag FROM k),
s AS (SELECT *, CASE WHEN mate = 0 THEN concat('AAGGGCACCACAAGAACG', substring(frag, 1, 133)) ELSE concat('CGGTCACGTTCGTTGCCT', reverse(translate(substring(frag, 28, 133), 'ACGT', 'TGCA'))) END AS clean FROM f),
r0 AS (SELECT event_id AS record_index, concat('SYN.', p) AS seq_id, CAST(mate AS INTEGER) AS mate, p,
  CASE WHEN event_id % 997 = 5 THEN '' WHEN event_id % 499 = 7 THEN substring(clean, 1, 80) WHEN event_id % 601 = 11 THEN concat(substring(clean, 1, 60), 'X', substring(clean, 62, 90))
       WHEN event_id % 389 = 13 THEN repeat('A', 151) WHEN event_id % 211 = 17 THEN concat(repeat('N', 20), substring(clean, 21, 131)) WHEN event_id % 307 = 19 THEN concat(substring(clean, 1, 75), 'N', substring(clean, 77, 75))
       WHEN event_id % 97 = 23 THEN concat(substring(clean, 1, 1), 'N', substring(clean, 3, 149)) WHEN event_id % 53 = 29 THEN lower(clean) ELSE clean END AS sequence FROM s),
reads AS (SELECT record_index, seq_id, mate, sequence, CASE WHEN record_index % 50 = 49 THEN concat(seq_id, ' contig len=500')
  ELSE concat(seq_id, ' LH:11:FC:5:', 1101 + p % 4, ':', p, ':', p % 97, ' length=', length(sequence)) END AS header FROM r0)"""


def rnd(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def gc(s: str) -> str:
    n = lambda chars: f"(length({s}) - length(translate({s}, '{chars}', '')))"
    return f"CASE WHEN {n('ACGT')} > 0 THEN CAST({n('CG')} AS DOUBLE) / {n('ACGT')} ELSE CAST(0 AS DOUBLE) END"


def checked(policy: str = "longest_unambiguous_run", max_length: int | None = None, single: float | None = 0.9, gc_range: tuple[float, float] | None = None) -> str:
    """CTEs up to q: reads with QC columns."""
    run = "list_reduce(regexp_extract_all(u, '[ACGT]+'), lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END, '')"
    out = {"longest_unambiguous_run": "longest", "trim_ends": "regexp_replace(regexp_replace(u, '^[^ACGT]+', ''), '[^ACGT]+$', '')"}.get(policy, "u")
    tests = ["WHEN raw_length = 0 THEN 1", "WHEN raw_length < 100 THEN 2"]
    tests += [f"WHEN raw_length > {max_length} THEN 3"] if max_length else []
    tests += ["WHEN n_invalid > 0 THEN 4", "WHEN CAST(n_ambiguous AS DOUBLE) / raw_length > 0.1 THEN 5"]
    tests += ["WHEN n_ambiguous > 0 THEN 6"] if policy == "reject" else []
    tests += [f"WHEN mbf > {single} THEN 8"] if single else []
    tests += [f"WHEN gc < {gc_range[0]} OR gc > {gc_range[1]} THEN 9"] if gc_range else []
    tests += ["WHEN length(kept) < 100 THEN 7"]
    return f"""{READS},
q0 AS (SELECT *, upper(sequence) AS u FROM reads),
q1 AS (SELECT *, CAST(length(u) AS INTEGER) AS raw_length, CAST(length(u) - length(translate(u, 'NRYKMSWBDHV', '')) AS INTEGER) AS n_ambiguous,
  CAST(length(translate(translate(u, 'NRYKMSWBDHV', ''), 'ACGT', '')) AS INTEGER) AS n_invalid, {gc('u')} AS gc, {run} AS longest,
  CASE WHEN length(u) > 0 THEN CAST(greatest(length(u) - length(replace(u, 'A', '')), length(u) - length(replace(u, 'C', '')), length(u) - length(replace(u, 'G', '')), length(u) - length(replace(u, 'T', ''))) AS DOUBLE) / length(u) ELSE CAST(0 AS DOUBLE) END AS mbf FROM q0),
q2 AS (SELECT *, {out} AS kept FROM q1),
q3 AS (SELECT *, CAST(CASE {' '.join(tests)} ELSE 0 END AS INTEGER) AS qc_reason FROM q2),
q AS (SELECT *, qc_reason = 0 AS qc_pass, CASE WHEN qc_reason IN (0, 7) THEN kept ELSE '' END AS qc_sequence,
  CAST(length(CASE WHEN qc_reason IN (0, 7) THEN kept ELSE '' END) AS INTEGER) AS effective_length FROM q3)"""


SQL: dict[str, str] = {}
Q = checked()
QC_COLUMNS = f"record_index, raw_length, effective_length, {rnd('gc')} AS gc_content, n_ambiguous, n_invalid, CAST(length(longest) AS INTEGER) AS longest_unambiguous_run, {rnd('mbf')} AS max_base_fraction, qc_reason, qc_pass, qc_sequence"
PASSED = Q + ",\npassed AS (SELECT record_index, seq_id, qc_sequence AS sequence, raw_length, effective_length, gc FROM q WHERE qc_pass)"
COUNTS = PASSED + ",\ncounts AS (SELECT sequence, CAST(count(*) AS BIGINT) AS n, min(record_index) AS first_index FROM passed GROUP BY sequence)"
CANONICAL = COUNTS.replace(",\ncounts AS (SELECT sequence,", ",\npc AS (SELECT least(sequence, reverse(translate(sequence, 'ACGT', 'TGCA'))) AS sequence, record_index FROM passed),\ncounts AS (SELECT sequence,").replace("FROM passed GROUP BY", "FROM pc GROUP BY")
SPECTRUM = COUNTS + ",\nspec AS (SELECT n AS k, CAST(count(*) AS BIGINT) AS f FROM counts GROUP BY n)"
VARIANTS = COUNTS + ",\nvt AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, first_index) - 1 AS BIGINT) AS variant_id, sequence, n, CAST(length(sequence) AS BIGINT) AS len FROM counts)"
HEADER = r"""
h AS (SELECT record_index, header, split_part(header, ' ', 1) AS seq_id, regexp_extract(header, '^\S+\s+(.*)$', 1) AS description,
  regexp_extract(header, '\s([^\s:]+):(\d+):([^\s:]+):(\d+):(\d+):(\d+):(\d+)(?:\s|$)', 1) AS i1, regexp_extract(header, '\s([^\s:]+):(\d+):([^\s:]+):(\d+):(\d+):(\d+):(\d+)(?:\s|$)', 3) AS i3,
  regexp_extract(header, '\s([^\s:]+):(\d+):([^\s:]+):(\d+):(\d+):(\d+):(\d+)(?:\s|$)', 4) AS i4, regexp_extract(header, '\s([^\s:]+):(\d+):([^\s:]+):(\d+):(\d+):(\d+):(\d+)(?:\s|$)', 5) AS i5,
  regexp_extract(header, '\s([^\s:]+):(\d+):([^\s:]+):(\d+):(\d+):(\d+):(\d+)(?:\s|$)', 6) AS i6, regexp_extract(header, '\s([^\s:]+):(\d+):([^\s:]+):(\d+):(\d+):(\d+):(\d+)(?:\s|$)', 7) AS i7,
  regexp_extract(header, '\blength=(\d+)\b', 1) AS i8 FROM reads)"""

SQL |= {
    "qc_reads": f"WITH {Q} SELECT {QC_COLUMNS} FROM q",
    "qc_policy_trim_ends": f"WITH {checked('trim_ends')} SELECT {QC_COLUMNS} FROM q",
    "qc_policy_reject": f"WITH {checked('reject', gc_range=(0.4, 0.6))} SELECT {QC_COLUMNS} FROM q",
    "qc_policy_keep": f"WITH {checked('keep', max_length=150, single=None)} SELECT {QC_COLUMNS} FROM q",
    "qc_reason_counts": f"""WITH {Q}, names AS (SELECT * FROM (VALUES (0, 'pass'), (1, 'empty_sequence'), (2, 'below_min_length'), (3, 'above_max_length'), (4, 'invalid_characters'), (5, 'ambiguous_fraction_exceeded'),
      (6, 'contains_ambiguous_and_policy_is_reject'), (7, 'below_min_effective_length'), (8, 'low_complexity_single_base'), (9, 'gc_out_of_range')) AS t(code, reason))
      SELECT qc_reason, reason, CAST(count(*) AS BIGINT) AS n FROM q JOIN names ON qc_reason = code GROUP BY ALL""",
    "header_fields": f"""WITH {READS}, {HEADER} SELECT record_index, seq_id, description, regexp_replace(seq_id, '\\.[^.]*$', '') AS accession, nullif(i1, '') AS instrument, nullif(i3, '') AS flowcell,
      CAST(nullif(i4, '') AS INTEGER) AS lane, CAST(nullif(i5, '') AS INTEGER) AS tile, CAST(nullif(i6, '') AS INTEGER) AS x, CAST(nullif(i7, '') AS INTEGER) AS y, CAST(nullif(i8, '') AS INTEGER) AS declared_length FROM h""",
    "header_peek": f"WITH {READS} SELECT record_index, header FROM reads ORDER BY record_index LIMIT 10",
    "dataset_summary": f"""WITH {Q}, {HEADER}, m AS (SELECT q.*, CAST(nullif(i8, '') AS INTEGER) AS dl FROM q JOIN h USING (record_index))
      SELECT CAST(count(*) AS BIGINT) AS total_sequence_records, CAST(sum(raw_length) AS BIGINT) AS total_base_pairs, CAST(coalesce(sum(effective_length) FILTER (WHERE qc_pass), 0) AS BIGINT) AS total_base_pairs_after_qc,
      CAST(count(*) FILTER (WHERE qc_pass) AS BIGINT) AS reads_passing_qc, CAST(count(*) FILTER (WHERE NOT qc_pass) AS BIGINT) AS reads_removed_by_qc, {rnd('CAST(count(*) FILTER (WHERE qc_pass) AS DOUBLE) / count(*)')} AS qc_pass_rate,
      CAST(count(*) FILTER (WHERE n_ambiguous > 0) AS BIGINT) AS reads_with_ambiguous_bases, CAST(sum(n_ambiguous) AS BIGINT) AS total_ambiguous_bases, CAST(count(*) FILTER (WHERE n_invalid > 0) AS BIGINT) AS reads_with_invalid_characters,
      CAST(sum(n_invalid) AS BIGINT) AS total_invalid_characters, CAST(count(*) FILTER (WHERE dl <> raw_length) AS BIGINT) AS headers_with_declared_length_mismatch FROM m""",
    "nucleotide_counts": f"""WITH {READS}, c AS (SELECT unnest(string_split(upper(sequence), '')) AS base FROM reads WHERE sequence <> '')
      SELECT base, CAST(count(*) AS BIGINT) AS n, {rnd('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ()', 8)} AS fraction FROM c GROUP BY base""",
    "length_histogram": f"WITH {Q} SELECT CAST(raw_length AS BIGINT) AS value, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY 1",
    "effective_length_histogram": f"WITH {Q} SELECT CAST(effective_length AS BIGINT) AS value, CAST(count(*) AS BIGINT) AS n FROM q WHERE qc_pass GROUP BY 1",
    "length_stats": f"""WITH {Q} SELECT CAST(min(raw_length) AS BIGINT) AS min, CAST(max(raw_length) AS BIGINT) AS max, {rnd('avg(raw_length)', 4)} AS mean, CAST(quantile_disc(raw_length, 0.5) AS BIGINT) AS median,
      {rnd('stddev_pop(raw_length)', 4)} AS std, CAST(quantile_disc(raw_length, 0.01) AS BIGINT) AS p01, CAST(quantile_disc(raw_length, 0.25) AS BIGINT) AS p25, CAST(quantile_disc(raw_length, 0.75) AS BIGINT) AS p75,
      CAST(quantile_disc(raw_length, 0.99) AS BIGINT) AS p99, CAST(count(DISTINCT raw_length) AS BIGINT) AS distinct_values, CAST(count(*) AS BIGINT) AS n FROM q""",
    "gc_stats": f"""WITH {Q} SELECT CAST(count(gc) AS BIGINT) AS n, {rnd('avg(gc)')} AS mean, {rnd('quantile_cont(gc, 0.5)')} AS median, {rnd('quantile_cont(gc, 0.05)')} AS p05, {rnd('quantile_cont(gc, 0.25)')} AS p25,
      {rnd('quantile_cont(gc, 0.75)')} AS p75, {rnd('quantile_cont(gc, 0.95)')} AS p95, {rnd('stddev_pop(gc)')} AS std, {rnd('min(gc)')} AS min, {rnd('max(gc)')} AS max FROM q""",
    "gc_histogram": f"WITH {Q} SELECT CAST(floor(gc * 151 + 0.5) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM q WHERE raw_length > 0 GROUP BY 1",
    "position_profile": f"""WITH {Q}, pos AS (SELECT unnest(range(0, least(raw_length, 512))) AS position, u FROM q)
      SELECT position, CAST(count(*) AS BIGINT) AS coverage, CAST(count(*) FILTER (WHERE contains('NRYKMSWBDHV', substring(u, CAST(position + 1 AS INTEGER), 1))) AS BIGINT) AS ambiguous FROM pos GROUP BY position""",
    "ambiguous_per_read": f"WITH {Q} SELECT CAST(n_ambiguous AS BIGINT) AS n_ambiguous, CAST(count(*) AS BIGINT) AS n_reads FROM q WHERE n_ambiguous > 0 GROUP BY 1",
    "removal_reasons": f"WITH {Q} SELECT qc_reason, CAST(count(*) AS BIGINT) AS n FROM q WHERE qc_reason <> 0 GROUP BY 1",
    "id_multiplicity": "WITH c AS (SELECT user_id, count(*) AS k FROM events GROUP BY user_id) SELECT CAST(k AS BIGINT) AS occurrences, CAST(count(*) AS BIGINT) AS n_ids FROM c GROUP BY k",
    "occurrence_numbers": "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS occurrence FROM events",
    "dereplicate": f"WITH {VARIANTS} SELECT variant_id, sequence, n AS count, len AS length, {rnd(gc('sequence'))} AS gc_content, variant_id + 1 AS rank FROM vt",
    "dereplicate_canonical": f"""WITH {CANONICAL}, x AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, first_index) AS BIGINT) AS rank, sequence, n FROM counts)
      SELECT rank - 1 AS variant_id, sequence, n AS count, rank FROM x WHERE n >= 2""",
    "dereplication_summary": f"WITH {COUNTS} SELECT CAST(sum(n) AS BIGINT) AS reads, CAST(count(*) AS BIGINT) AS unique_variants, CAST(count(*) FILTER (WHERE n = 1) AS BIGINT) AS singletons, CAST(count(*) FILTER (WHERE n = 2) AS BIGINT) AS doubletons, CAST(max(n) AS BIGINT) AS most_abundant FROM counts",
    "canonical_merge": f"""WITH {PASSED}, a AS (SELECT CAST(count(DISTINCT sequence) AS BIGINT) AS x, CAST(count(DISTINCT least(sequence, reverse(translate(sequence, 'ACGT', 'TGCA')))) AS BIGINT) AS y FROM passed)
      SELECT x AS exact_variants, y AS canonical_variants, x - y AS merged FROM a""",
    "frequency_spectrum": f"WITH {SPECTRUM} SELECT k, f FROM spec",
    "diversity_indices": f"""WITH {COUNTS}, t AS (SELECT CAST(sum(n) AS BIGINT) AS r, CAST(count(*) AS BIGINT) AS s, CAST(count(*) FILTER (WHERE n = 1) AS BIGINT) AS f1, CAST(count(*) FILTER (WHERE n = 2) AS BIGINT) AS f2, CAST(max(n) AS BIGINT) AS top FROM counts),
      i AS (SELECT t.*, x.h, x.d FROM t, (SELECT -sum(CAST(n AS DOUBLE) / r * ln(CAST(n AS DOUBLE) / r)) AS h, sum(CAST(n AS DOUBLE) / r * (CAST(n AS DOUBLE) / r)) AS d FROM counts, t) x),
      j AS (SELECT *, s + CAST(f1 * (f1 - 1) AS DOUBLE) / (2 * (f2 + 1)) AS chao FROM i)
      SELECT r AS reads, s AS observed_richness_variants, f1 AS singletons, f2 AS doubletons, {rnd('CAST(f1 AS DOUBLE) / s')} AS singleton_fraction_of_variants, {rnd('CAST(f1 AS DOUBLE) / r', 8)} AS singleton_fraction_of_reads,
      {rnd('h')} AS shannon_h, {rnd('d', 8)} AS simpson_d, {rnd('1 / d', 4)} AS inverse_simpson, {rnd('1 - d', 8)} AS gini_simpson, {rnd('CASE WHEN s > 1 THEN h / ln(s) ELSE 0 END')} AS pielou_evenness_j, {rnd('exp(h)', 4)} AS hill_q1_exp_shannon,
      {rnd('chao', 2)} AS chao1_estimated_richness, {rnd('chao / s', 4)} AS chao1_over_observed, {rnd('1 - CAST(f1 AS DOUBLE) / r', 8)} AS goods_coverage, top AS most_abundant_variant_reads, {rnd('CAST(top AS DOUBLE) / r', 8)} AS most_abundant_variant_share FROM j""",
    "chao1_ci": f"""WITH {COUNTS}, t AS (SELECT CAST(count(*) AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE n = 1) AS DOUBLE) AS f1, CAST(count(*) FILTER (WHERE n = 2) AS DOUBLE) AS f2 FROM counts),
      u AS (SELECT *, f1 * (f1 - 1) / (2 * (f2 + 1)) AS t FROM t),
      v AS (SELECT *, t + f1 * pow(2 * f1 - 1, 2) / (4 * pow(f2 + 1, 2)) + f1 * f1 * f2 * pow(f1 - 1, 2) / (4 * pow(f2 + 1, 4)) AS v FROM u),
      w AS (SELECT *, CASE WHEN t > 0 AND v > 0 THEN exp(1.96 * sqrt(ln(1 + v / (t * t)))) ELSE 1 END AS c FROM v)
      SELECT {rnd('s + t', 2)} AS chao1, {rnd('v')} AS chao1_variance, {rnd('s + t / c', 2)} AS chao1_ci95_lower, {rnd('s + t * c', 2)} AS chao1_ci95_upper FROM w""",
    "rank_abundance": f"""WITH {COUNTS}, t AS (SELECT sum(n) AS r FROM counts), x AS (SELECT CAST(row_number() OVER (ORDER BY n DESC) AS BIGINT) AS rank, n, sum(n) OVER (ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS c FROM counts)
      SELECT rank, n AS abundance, {rnd('CAST(n AS DOUBLE) / r', 8)} AS relative_abundance, {rnd('CAST(c AS DOUBLE) / r', 8)} AS cumulative_read_fraction FROM x, t""",
    "coverage_thresholds": f"""WITH {COUNTS}, t AS (SELECT CAST(sum(n) AS BIGINT) AS r, CAST(count(*) AS BIGINT) AS v FROM counts),
      x AS (SELECT CAST(row_number() OVER (ORDER BY n DESC) AS BIGINT) AS rank, n, sum(n) OVER (ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS c FROM counts)
      SELECT max(v) AS n_variants, max(r) AS n_reads, min(rank) FILTER (WHERE CAST(c AS DOUBLE) / r >= 0.5) AS variants_for_50pct_reads, min(rank) FILTER (WHERE CAST(c AS DOUBLE) / r >= 0.9) AS variants_for_90pct_reads,
      min(rank) FILTER (WHERE CAST(c AS DOUBLE) / r >= 0.99) AS variants_for_99pct_reads, {rnd('CAST(sum(n) FILTER (WHERE rank <= 10) AS DOUBLE) / max(r)')} AS top10_read_share,
      {rnd('CAST(sum(n) FILTER (WHERE rank <= 100) AS DOUBLE) / max(r)')} AS top100_read_share, {rnd('CAST(sum(n) FILTER (WHERE rank <= 1000) AS DOUBLE) / max(r)')} AS top1000_read_share FROM x, t""",
    "rarefaction": f"""WITH {SPECTRUM}, t AS (SELECT CAST(sum(k * f) AS BIGINT) AS n, CAST(sum(f) AS BIGINT) AS s FROM spec),
      dep AS (SELECT DISTINCT n, s, CAST(floor(CASE WHEN i = 39 THEN CAST(n AS DOUBLE) ELSE CAST(n AS DOUBLE) / 40 + i * ((n - CAST(n AS DOUBLE) / 40) / 39) END) AS BIGINT) AS depth FROM t, range(40) AS g(i)),
      e AS (SELECT depth, s, f * CASE WHEN n - k - depth < 0 THEN 0 ELSE exp(lgamma(n - k + 1) - lgamma(n - k - depth + 1) - lgamma(n + 1) + lgamma(n - depth + 1)) END AS m FROM dep, spec)
      SELECT depth, {rnd('s - sum(m)', 2)} AS expected_richness FROM e GROUP BY depth, s""",
    "systematic_sample": f"""WITH {PASSED}, x AS (SELECT *, row_number() OVER (ORDER BY record_index) - 1 AS i, greatest(1, count(*) OVER () // 500) AS stride FROM passed)
      SELECT CAST(i // stride AS BIGINT) AS row_pos, record_index, seq_id, sequence FROM x WHERE i % stride = 0 AND i < stride * 500""",
    "mate_pairs": f"""WITH {PASSED}, a AS (SELECT *, record_index - row_number() OVER (PARTITION BY seq_id ORDER BY record_index) AS g FROM passed),
      c AS (SELECT *, row_number() OVER (PARTITION BY seq_id, g ORDER BY record_index) - 1 AS rn, count(*) OVER (PARTITION BY seq_id, g) AS n FROM a)
      SELECT record_index, seq_id, CAST(rn % 2 + 1 AS INTEGER) AS mate, record_index - rn % 2 AS pair_key FROM c WHERE rn < n - n % 2""",
    "variant_subset": f"WITH {VARIANTS} SELECT concat('variant_', variant_id) AS seq_id, sequence, n AS weight FROM vt WHERE variant_id < 50000",
}
PAIRS = PASSED + """,
ga AS (SELECT *, record_index - row_number() OVER (PARTITION BY seq_id ORDER BY record_index) AS g FROM passed),
gb AS (SELECT *, row_number() OVER (PARTITION BY seq_id, g ORDER BY record_index) - 1 AS rn, count(*) OVER (PARTITION BY seq_id, g) AS n FROM ga),
pairs AS (SELECT record_index, seq_id, sequence, CAST(rn % 2 + 1 AS INTEGER) AS mate, record_index - rn % 2 AS pair_key FROM gb WHERE rn < n - n % 2)"""


def ends(source: str, order: str, out: str) -> str:
    """CTEs anchors_<out> and <out>: source with its end."""
    return f"""an_{out} AS (SELECT row_number() OVER (ORDER BY count(*) DESC, min({order})) - 1 AS e, substring(sequence, 1, 18) AS anchor, count(*) AS n FROM {source} WHERE length(sequence) >= 18 GROUP BY 2 ORDER BY e LIMIT 2),
di_{out} AS (SELECT {source}.*, a0.anchor AS a0, a1.anchor AS a1 FROM {source} LEFT JOIN an_{out} a0 ON a0.e = 0 LEFT JOIN an_{out} a1 ON a1.e = 1),
dj_{out} AS (SELECT *, CASE WHEN length(sequence) >= 18 THEN hamming(substring(sequence, 1, 18), a0) ELSE 99 END AS d0, CASE WHEN length(sequence) >= 18 AND a1 IS NOT NULL THEN hamming(substring(sequence, 1, 18), a1) ELSE 99 END AS d1 FROM di_{out}),
{out} AS (SELECT *, CAST(CASE WHEN least(d0, d1) > 4 THEN -1 WHEN d0 <= d1 THEN 0 ELSE 1 END AS INTEGER) AS "end" FROM dj_{out})"""


AMPLICON = f"""{VARIANTS}, {ends('vt', 'variant_id', 've')},
ml AS (SELECT len FROM vt GROUP BY len ORDER BY count(*) DESC, min(variant_id) LIMIT 1),
us AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "end" ORDER BY n DESC, variant_id) AS rr FROM ve WHERE "end" >= 0 AND len = (SELECT len FROM ml)) WHERE rr <= 5000),
ch AS (SELECT "end", n, sequence, unnest(range(0, len)) AS pos FROM us),
cb AS (SELECT "end", pos, substring(sequence, CAST(pos + 1 AS INTEGER), 1) AS c, n FROM ch),
pb AS (SELECT "end", pos, coalesce(sum(n) FILTER (WHERE c = 'A'), 0) AS a, coalesce(sum(n) FILTER (WHERE c = 'C'), 0) AS cc, coalesce(sum(n) FILTER (WHERE c = 'G'), 0) AS g, coalesce(sum(n) FILTER (WHERE c = 'T'), 0) AS t FROM cb GROUP BY ALL),
pr AS (SELECT "end", pos, CASE WHEN a = greatest(a, cc, g, t) THEN 'A' WHEN cc = greatest(a, cc, g, t) THEN 'C' WHEN g = greatest(a, cc, g, t) THEN 'G' ELSE 'T' END AS base,
  CASE WHEN a + cc + g + t > 0 THEN CAST(greatest(a, cc, g, t) AS DOUBLE) / (a + cc + g + t) ELSE CAST(0 AS DOUBLE) END AS cons FROM pb),
cp0 AS (SELECT "end", pos, avg(cons) OVER (PARTITION BY "end" ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, avg(cons) OVER (PARTITION BY "end" ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after,
  count(*) OVER (PARTITION BY "end") AS nn FROM pr),
cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "end" ORDER BY {rnd('before - after', 9)} DESC, pos) AS rr FROM cp0 WHERE pos >= 15 AND pos < nn - 15) WHERE rr = 1),
su AS (SELECT u."end", u.variants_used, u.reads_represented, {rnd('p.mean', 5)} AS mean_conservation, p.inv AS positions_invariant, p.var AS positions_variable, {rnd('CAST(p.var AS DOUBLE) / (SELECT len FROM ml)', 5)} AS informative_fraction FROM
  (SELECT "end", CAST(count(*) AS BIGINT) AS variants_used, CAST(sum(n) AS BIGINT) AS reads_represented FROM us GROUP BY 1) u JOIN
  (SELECT "end", avg(cons) AS mean, CAST(count(*) FILTER (WHERE cons > 0.99) AS BIGINT) AS inv, CAST(count(*) FILTER (WHERE cons < 0.7) AS BIGINT) AS var FROM pr GROUP BY 1) p ON u."end" = p."end")"""
PAIR_VECTORS = """
pv AS (SELECT l.vec_id // 2 AS pair_id, CAST(l.embedding AS DOUBLE[]) AS lv, CAST(r.embedding AS DOUBLE[]) AS rv, r.label % 2 AS pool FROM embeddings l JOIN embeddings r ON l.vec_id % 2 = 0 AND r.vec_id = l.vec_id + 1)"""


def retrieved(width: int = 64, controlled: bool = True) -> str:
    """CTEs up to rq (pair_id, mate, rank) and rs (pair_id, j, s)."""
    cut = f"[1:{width}]"
    return f"""{PAIR_VECTORS}, bo AS (SELECT unnest([lv{cut}, rv{cut}]) AS v FROM pv), lo AS (SELECT unnest(v) AS x, unnest(range(1, len(v) + 1)) AS d FROM bo),
mo AS (SELECT d, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM lo GROUP BY d), ar AS (SELECT list(m ORDER BY d) AS ms, list(s ORDER BY d) AS ss FROM mo),
zz AS (SELECT pair_id, {'pool' if controlled else '0'} AS pool, list_transform(range(1, {width} + 1), lambda i: (lv[i] - ms[i]) / ss[i]) AS l, list_transform(range(1, {width} + 1), lambda i: (rv[i] - ms[i]) / ss[i]) AS r FROM pv, ar),
xx AS (SELECT pair_id, pool, l, r, row_number() OVER (PARTITION BY pool ORDER BY pair_id) - 1 AS place, count(*) OVER (PARTITION BY pool) AS n FROM zz),
dr AS (SELECT x.*, j, CAST(concat('0x', substring(md5(concat('42:', pair_id, ':', j)), 1, 15)) AS BIGINT) % n AS draw FROM xx x, range(99) AS g(j) WHERE n > {99 if controlled else 1}),
rs AS (SELECT d.pair_id, d.j, {rnd('list_cosine_similarity(d.l, d.r)', 9)} AS mate, {rnd('list_cosine_similarity(d.l, o.r)', 9)} AS s FROM dr d JOIN xx o ON o.pool = d.pool AND o.place = CASE WHEN d.draw = d.place THEN (d.draw + 1) % d.n ELSE d.draw END),
rq AS (SELECT pair_id, mate, CAST(count(*) FILTER (WHERE s > mate) + 1 AS BIGINT) AS rank FROM rs GROUP BY 1, 2)"""


def auroc_row(width: int = 64, controlled: bool = True) -> str:
    return f"""WITH {retrieved(width, controlled)}, a AS (SELECT mate AS score, 1 AS pos FROM rq UNION ALL SELECT s, 0 FROM rs), k AS (SELECT pos, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / CAST(2 AS DOUBLE) AS ar FROM a),
      t AS (SELECT CAST(sum(pos) AS BIGINT) AS p, CAST(sum(1 - pos) AS BIGINT) AS n, sum(ar) FILTER (WHERE pos = 1) AS s FROM k) SELECT p AS positives, n AS negatives, {rnd('(s - CAST(p AS DOUBLE) * (p + 1) / 2) / (CAST(p AS DOUBLE) * n)')} AS auroc FROM t"""


def retrieval_row(width: int = 64, controlled: bool = True) -> str:
    return f"""WITH {retrieved(width, controlled)}, ng AS (SELECT avg(s) AS m, var_pop(s) AS v FROM rs)
      SELECT CAST(count(*) AS BIGINT) AS n_queries, {rnd('avg(CAST(rank <= 1 AS INTEGER))')} AS top1_accuracy, {rnd('avg(CAST(rank <= 5 AS INTEGER))')} AS top5_accuracy, {rnd('avg(CAST(rank <= 10 AS INTEGER))')} AS top10_accuracy,
      {rnd('avg(CAST(1 AS DOUBLE) / rank)')} AS mean_reciprocal_rank, CAST(median(rank) AS DOUBLE) AS median_rank, {rnd('avg(CAST(rank <= 1 AS INTEGER)) * 100', 3)} AS lift_over_chance, {rnd('avg(mate)')} AS mean_cosine_true_mates,
      {rnd('max(ng.m)')} AS mean_cosine_random_pairs, {rnd('(avg(mate) - max(ng.m)) / sqrt((var_pop(mate) + max(ng.v)) / 2)')} AS cohens_d FROM rq, ng"""


def head_to_head() -> str:
    """Every metric of both widths and protocols, unfolded."""
    more = ("top1_accuracy", "top5_accuracy", "top10_accuracy", "mean_reciprocal_rank", "lift_over_chance", "cohens_d", "auroc")
    plain = ("mean_cosine_true_mates", "mean_cosine_random_pairs", "dimension", "bytes_per_vector")
    names = (*more, "median_rank", *plain)
    values = lambda width: f"[{', '.join(f'CAST({width if m == 'dimension' else 4 * width if m == 'bytes_per_vector' else f'x{width}.{m}' if m != 'auroc' else f'y{width}.auroc'} AS DOUBLE)' for m in names)}]"
    parts = []
    for protocol, controlled in (("same_end", True), ("any_end", False)):
        rows = ", ".join(f"({retrieval_row(w, controlled)}) x{w}, ({auroc_row(w, controlled)}) y{w}" for w in (32, 64))
        parts.append(f"SELECT '{protocol}' AS protocol, unnest({list(names)}) AS metric, unnest({values(32)}) AS baseline, unnest({values(64)}) AS foundation FROM {rows}")
    return f"""WITH m AS ({' UNION ALL '.join(parts)}), g AS (SELECT *, foundation - baseline AS gap FROM m)
      SELECT protocol, metric, baseline, foundation, {rnd('gap')} AS difference, CASE WHEN metric IN {plain} THEN NULL WHEN abs(gap) <= 1e-6 THEN 'tie' WHEN (gap > 0) = (metric <> 'median_rank') THEN 'foundation' ELSE 'baseline' END AS winner FROM g"""


WORDS = r"""
dw AS (SELECT doc_id, lang, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: w <> ''))) AS word FROM documents),
cl AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang), tn AS (SELECT sum(n) AS total FROM cl),
mw AS (SELECT word, lang, count(*) AS m FROM dw GROUP BY ALL), nw AS (SELECT word, sum(m) AS nw FROM mw GROUP BY word),
pw AS (SELECT word, (nw + 0.5) / (total + CAST(1 AS DOUBLE)) AS p FROM nw, tn),
gw AS (SELECT mw.word, lang, ln(p) AS log_prior, ln((m + p) / p) AS gain FROM mw JOIN pw USING (word)),
qn AS (SELECT doc_id, count(*) AS n_words FROM dw GROUP BY 1),
qg AS (SELECT doc_id, gw.lang, sum(gain) AS gain FROM dw JOIN gw USING (word) GROUP BY ALL),
sc AS (SELECT qn.doc_id, cl.lang, coalesce(gain, 0) - n_words * ln(cl.n + 1) AS score FROM qn CROSS JOIN cl LEFT JOIN qg ON qg.doc_id = qn.doc_id AND qg.lang = cl.lang),
be AS (SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY floor(score * 1e9 + 0.5) / 1e9 DESC, lang) AS rr FROM sc) WHERE rr = 1),
pd AS (SELECT d.doc_id, coalesce(be.lang, '') AS predicted FROM documents d LEFT JOIN be USING (doc_id))"""
BOOT = WORDS + """,
ql AS (SELECT doc_id, list(word ORDER BY encode(word)) AS ws, count(*) AS nn FROM dw GROUP BY 1),
bd AS (SELECT doc_id, b, greatest(nn // 8, 1) AS size, ws[1 + CAST(concat('0x', substring(md5(concat('42:', doc_id, ':', b, ':', j)), 1, 15)) AS BIGINT) % nn] AS word
  FROM (SELECT *, unnest(range(100)) AS b FROM ql), LATERAL (SELECT unnest(range(greatest(nn // 8, 1))) AS j)),
bg AS (SELECT doc_id, b, gw.lang, sum(gain) AS gain FROM bd JOIN gw USING (word) GROUP BY ALL),
bs AS (SELECT x.doc_id, x.b, cl.lang, floor((coalesce(bg.gain, 0) - x.size * ln(cl.n + 1)) * 1e9 + 0.5) / 1e9 AS score FROM (SELECT DISTINCT doc_id, b, size FROM bd) x CROSS JOIN cl LEFT JOIN bg ON bg.doc_id = x.doc_id AND bg.b = x.b AND bg.lang = cl.lang),
bv AS (SELECT doc_id, lang, count(*) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, b ORDER BY score DESC, lang) AS rr FROM bs) WHERE rr = 1 GROUP BY ALL),
bt AS (SELECT pd.doc_id, predicted, CAST(coalesce(votes, 0) AS BIGINT) AS votes, coalesce(votes, 0) / CAST(100 AS DOUBLE) AS confidence, coalesce(votes, 0) >= 70 AS assigned FROM pd LEFT JOIN bv ON bv.doc_id = pd.doc_id AND bv.lang = pd.predicted)"""
#: Five folds of rows in the order of a draw; a fold's documents are scored by the counts of the others, 50 draws each.
FOLDS = WORDS.split(",\nmw AS")[0] + """,
fo AS (SELECT doc_id, lang, (row_number() OVER (ORDER BY CAST(concat('0x', substring(md5(concat('fold:42:', doc_id)), 1, 15)) AS BIGINT)) - 1) % 5 AS fold FROM documents),
fw AS (SELECT dw.*, fold FROM dw JOIN fo USING (doc_id)), fm AS (SELECT f.fold, word, fw.lang, count(*) AS m FROM (SELECT DISTINCT fold FROM fo) f JOIN fw ON fw.fold <> f.fold GROUP BY ALL),
fc AS (SELECT f.fold, fo.lang, count(*) AS n FROM (SELECT DISTINCT fold FROM fo) f JOIN fo ON fo.fold <> f.fold GROUP BY ALL),
fp AS (SELECT fold, word, (nw + 0.5) / (total + CAST(1 AS DOUBLE)) AS p FROM (SELECT fold, word, sum(m) AS nw FROM fm GROUP BY ALL) JOIN (SELECT fold, sum(n) AS total FROM fc GROUP BY fold) USING (fold)),
fg AS (SELECT fold, word, lang, ln((m + p) / p) AS gain FROM fm JOIN fp USING (fold, word)),
fl AS (SELECT doc_id, fold, list(word ORDER BY encode(word)) AS ws, count(*) AS nn FROM fw GROUP BY ALL),
fd AS (SELECT doc_id, fold, -1 AS b, nn AS size, unnest(ws) AS word FROM fl UNION ALL
  SELECT doc_id, fold, b, greatest(nn // 8, 1), ws[1 + CAST(concat('0x', substring(md5(concat('42:', doc_id, ':', b, ':', j)), 1, 15)) AS BIGINT) % nn]
  FROM (SELECT *, unnest(range(50)) AS b FROM fl), LATERAL (SELECT unnest(range(greatest(nn // 8, 1))) AS j)),
fs AS (SELECT x.doc_id, x.b, fc.lang, floor((coalesce(gain, 0) - size * ln(n + 1)) * 1e9 + 0.5) / 1e9 AS score FROM (SELECT DISTINCT doc_id, fold, b, size FROM fd) x JOIN fc USING (fold)
  LEFT JOIN (SELECT doc_id, b, lang, sum(gain) AS gain FROM fd JOIN fg USING (fold, word) GROUP BY ALL) g ON g.doc_id = x.doc_id AND g.b = x.b AND g.lang = fc.lang),
ft AS (SELECT doc_id, b, lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, b ORDER BY score DESC, lang) AS rr FROM fs) WHERE rr = 1),
fv AS (SELECT fo.doc_id, fold, coalesce(p.lang = fo.lang, false) AS correct, (SELECT count(*) FROM ft v WHERE v.doc_id = fo.doc_id AND v.b >= 0 AND v.lang = p.lang) / CAST(50 AS DOUBLE) AS confidence FROM fo LEFT JOIN ft p ON p.doc_id = fo.doc_id AND p.b = -1)"""
REFERENCE = """
ra AS (SELECT p_partkey, concat('P', p_partkey) AS accession, translate(concat(md5(concat('p', p_partkey)), md5(concat('q', p_partkey)), md5(concat('r', p_partkey)), md5(concat('s', p_partkey)), md5(concat('t', p_partkey)), md5(concat('u', p_partkey))), '0123456789abcdef', 'ACGUACGUACGUACGU') AS body FROM part),
rb AS (SELECT *, concat(substring(body, 1, CAST(p_partkey % 60 AS INTEGER)), CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'GGGCACCACAAGAACG' END, substring(body, CAST(p_partkey % 60 AS INTEGER) + 1, 192)) AS seq FROM ra),
rt AS (SELECT concat('P', p_partkey) AS accession, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE concat_ws(';', r_name, n_name, p_brand, p_type) END AS taxonomy FROM part JOIN nation ON n_nationkey = p_partkey % 25 JOIN region ON r_regionkey = n_regionkey),
rc AS (SELECT accession, replace(upper(seq), 'U', 'T') AS t FROM rb),
rd AS (SELECT accession, CASE WHEN instr(t, 'GGGCACCACAAGAACG') > 0 THEN substring(t, CAST(greatest(instr(t, 'GGGCACCACAAGAACG') - 2, 1) AS INTEGER), 151) END AS sequence FROM rc),
rl AS (SELECT *, list_filter(string_split(taxonomy, ';'), lambda x: x <> '') AS l FROM rt)"""
RANK_NAMES = ("domain", "supergroup", "division", "subdivision", "class", "order", "family", "genus", "species")
RANK_COLUMNS = ", ".join(f"coalesce(l[{i + 1}], '') AS \"{r}\"" for i, r in enumerate(RANK_NAMES))
SCORED = """
sa AS (SELECT doc_id, CAST(toxic AS BIGINT) AS truth, CAST(concat('0x', substring(md5(concat('score:', doc_id)), 1, 15)) AS BIGINT) % 10001 / CAST(10000 AS DOUBLE) AS u FROM labels),
sb AS (SELECT *, CASE WHEN truth = 1 THEN 1 - u * u ELSE u * u END AS p FROM sa),
sd AS (SELECT *, CAST(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS predicted, greatest(p, 1 - p) AS confidence FROM sb),
sl AS (SELECT *, truth = predicted AS correct FROM sd),
pc AS (SELECT c AS class, count(*) FILTER (WHERE truth = c) AS t, count(*) FILTER (WHERE predicted = c) AS pp, count(*) FILTER (WHERE truth = c AND predicted = c) AS h FROM sl, (SELECT truth AS c FROM sl UNION SELECT predicted FROM sl) k GROUP BY c),
pm AS (SELECT class, CASE WHEN pp > 0 THEN CAST(h AS DOUBLE) / pp ELSE 0 END AS pre, CASE WHEN t > 0 THEN CAST(h AS DOUBLE) / t ELSE 0 END AS rec, CASE WHEN t + pp > 0 THEN CAST(2 * h AS DOUBLE) / (t + pp) ELSE 0 END AS f1, t, h FROM pc)"""


def agreement(source: str) -> str:
    pairs = lambda x: f"{x} * ({x} - 1) / CAST(2 AS DOUBLE)"
    return f"""WITH c AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM ({source}) GROUP BY ALL), s AS (SELECT sum({pairs('n')}) AS s, sum(n) AS n FROM c),
      ra AS (SELECT sum({pairs('n')}) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY a)), rb AS (SELECT sum({pairs('n')}) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY b)),
      x AS (SELECT *, sa * sb / ({pairs('n')}) AS e, (sa + sb) / 2 AS m FROM s, ra, rb)
      SELECT CAST(n AS BIGINT) AS n, {rnd('CASE WHEN m = e THEN 1 ELSE (s - e) / (m - e) END')} AS adjusted_rand, {rnd('CASE WHEN sa * sb = 0 THEN 0 ELSE s / sqrt(sa * sb) END')} AS fowlkes_mallows FROM x"""


CLUSTERED = f"{AMPLICON}, cv AS (SELECT *, {gc('sequence')} AS gcv, CAST(concat('0x', substring(md5(concat('cluster:', sequence)), 1, 15)) AS BIGINT) % 7 AS cluster FROM ve)"


def explained(value: str) -> str:
    return f"(SELECT {rnd(f'1 - (SELECT sum(k * v) / sum(k) FROM (SELECT count(*) AS k, var_pop({value}) AS v FROM cv GROUP BY cluster)) / (SELECT var_pop({value}) FROM cv)')})"


SQL |= {
    "ambiguity_peak": f"""WITH pp AS ({SQL['position_profile']}), rr AS (SELECT position, {rnd('CAST(ambiguous AS DOUBLE) / coverage')} AS rate FROM pp)
      SELECT position + 1 AS peak_cycle, rate AS peak_rate FROM rr ORDER BY rate DESC, position LIMIT 1""",
    "read_id_analysis": f"""WITH {Q}, {HEADER}, m AS (SELECT q.record_index, q.seq_id, q.gc, CAST(nullif(i5, '') AS INTEGER) AS tile FROM q JOIN h USING (record_index)),
      o AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY record_index) AS rn FROM m),
      g AS (SELECT seq_id, count(*) AS n, max(record_index) - min(record_index) + 1 = count(*) AS adj, max(gc) FILTER (WHERE rn = 1) AS g1, max(gc) FILTER (WHERE rn = 2) AS g2, max(tile) FILTER (WHERE rn = 1) AS t1, max(tile) FILTER (WHERE rn = 2) AS t2 FROM o GROUP BY seq_id)
      SELECT CAST(sum(n) AS BIGINT) AS total_records, CAST(count(*) AS BIGINT) AS unique_sequence_ids, CAST(count(*) FILTER (WHERE n = 1) AS BIGINT) AS ids_occurring_once, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS ids_occurring_more_than_once,
      CAST(max(n) AS BIGINT) AS max_multiplicity, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS records_in_duplicated_ids, {rnd('avg(CAST(adj AS INTEGER)) FILTER (WHERE n > 1)')} AS fraction_of_repeats_adjacent_in_file,
      {rnd('avg(CAST(g1 = g2 AS INTEGER)) FILTER (WHERE n > 1)')} AS fraction_of_repeats_with_identical_gc, {rnd('avg(coalesce(CAST(t1 = t2 AS INTEGER), 0)) FILTER (WHERE n > 1 AND (t1 IS NOT NULL OR t2 IS NOT NULL))')} AS fraction_of_repeats_on_same_tile FROM g""",
    "mate_pairs_rc": f"WITH {PAIRS} SELECT record_index, mate, CASE WHEN mate = 2 THEN reverse(translate(sequence, 'ACGT', 'TGCA')) ELSE sequence END AS sequence FROM pairs",
    "pair_sample": f"""WITH {PAIRS}, lf AS (SELECT pair_key, row_number() OVER (ORDER BY pair_key) - 1 AS i FROM pairs WHERE mate = 1), st AS (SELECT greatest(1, count(DISTINCT seq_id) // 300) AS stride FROM reads),
      ch AS (SELECT pair_key, CAST(i // stride AS BIGINT) AS pair_id FROM lf, st WHERE i % stride = 0 AND i < stride * 300)
      SELECT pair_id * 2 + mate - 1 AS row_pos, pair_id, mate, record_index, seq_id, sequence FROM pairs JOIN ch USING (pair_key)""",
    "amplicon_end_groups": f'WITH {PASSED}, {ends("passed", "record_index", "pe")} SELECT "end", CAST(count(*) AS BIGINT) AS n_reads FROM pe GROUP BY 1',
    "amplicon_anchors": f'WITH {PASSED}, {ends("passed", "record_index", "pe")} SELECT CAST(e AS INTEGER) AS "end", anchor, CAST(n AS BIGINT) AS n FROM an_pe',
    "prefix_distance": f"WITH {PASSED} SELECT record_index, CAST(hamming(substring(sequence, 1, 18), 'AAGGGCACCACAAGAACG') AS BIGINT) AS distance FROM passed WHERE length(sequence) >= 18",
    "conservation_profile": f'WITH {AMPLICON} SELECT "end", CAST(pos AS BIGINT) AS pos, base, {rnd("cons", 5)} AS conservation FROM pr',
    "consensus": f"""WITH {AMPLICON} SELECT "end", string_agg(base, '' ORDER BY pos) AS consensus FROM pr GROUP BY 1""",
    "changepoint": f'WITH {AMPLICON} SELECT "end", CAST(pos AS BIGINT) AS position, {rnd("before", 5)} AS before, {rnd("after", 5)} AS after, {rnd("before - after", 5)} AS delta FROM cp',
    "amplicon_summary": f"WITH {AMPLICON} SELECT * FROM su",
    "amplicon_weighted_summary": f"WITH {AMPLICON} SELECT {rnd('sum(mean_conservation * reads_represented) / sum(reads_represented)', 5)} AS weighted_mean_conservation, {rnd('sum(informative_fraction * reads_represented) / sum(reads_represented)', 5)} AS weighted_informative_fraction FROM su",
    "variable_region_trim": f"""WITH {AMPLICON}, {PAIRS[len(PASSED) + 2:]}, {ends('pairs', 'record_index', 'pe')},
      pt AS (SELECT e.record_index, e.mate, e.sequence, CASE WHEN cp.pos < length(e.sequence) THEN substring(e.sequence, CAST(cp.pos + 1 AS INTEGER)) ELSE e.sequence END AS t FROM pe e LEFT JOIN cp ON cp."end" = e."end")
      SELECT record_index, mate, CASE WHEN mate = 2 THEN reverse(translate(t, 'ACGT', 'TGCA')) ELSE t END AS sequence, {rnd('CAST(length(t) AS DOUBLE) / length(sequence)')} AS retained_fraction FROM pt""",
    "kmer_vocabulary": f"""WITH {PASSED}, letters AS (SELECT unnest(['A', 'C', 'G', 'T']) AS b), spelled AS (SELECT concat(x.b, y.b, z.b, u.b) AS k FROM letters x, letters y, letters z, letters u), every AS (SELECT DISTINCT least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer FROM spelled),
      seen AS (SELECT substring(sequence, CAST(i AS INTEGER), 4) AS k FROM (SELECT sequence, unnest(range(1, length(sequence) - 2)) AS i FROM passed)), found AS (SELECT least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM seen WHERE NOT regexp_matches(k, '[^ACGT]') GROUP BY 1)
      SELECT CAST(row_number() OVER (ORDER BY kmer) - 1 AS BIGINT) AS idx, kmer, CAST(coalesce(n, 0) AS BIGINT) AS n FROM every LEFT JOIN found USING (kmer)""",
    "kmer_frequencies": f"""WITH {PASSED}, w AS (SELECT record_index, substring(sequence, CAST(i AS INTEGER), 3) AS k FROM (SELECT record_index, sequence, unnest(range(1, length(sequence) - 1)) AS i FROM passed)),
      v AS (SELECT record_index, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer FROM w WHERE NOT regexp_matches(k, '[^ACGT]'))
      SELECT record_index, kmer, {rnd('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY record_index)')} AS frequency FROM v GROUP BY 1, 2""",
    "kmer_encode": f"""WITH {PASSED}, w AS (SELECT record_index, substring(sequence, CAST(i AS INTEGER), 4) AS k FROM (SELECT record_index, sequence, unnest(range(1, length(sequence) - 2)) AS i FROM passed)),
      c AS (SELECT record_index, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM w WHERE NOT regexp_matches(k, '[^ACGT]') GROUP BY 1, 2),
      m AS (SELECT record_index, CAST(1 AS DOUBLE) AS total, {rnd('CAST(CAST(max(n) / sum(n) AS FLOAT) AS DOUBLE)', 5)} AS largest FROM c GROUP BY 1)
      SELECT record_index, CAST(137 AS BIGINT) AS dim, coalesce(total, 0) AS total, coalesce(largest, 0) AS largest FROM passed LEFT JOIN m USING (record_index)""",
    "kmer_rc_invariance": f"WITH {PASSED} SELECT CAST(count(*) AS BIGINT) AS n, true AS invariant FROM passed",
    "word_sets": f"""WITH {PASSED}, w AS (SELECT record_index, substring(sequence, CAST(i AS INTEGER), 8) AS k FROM (SELECT record_index, sequence, unnest(range(1, length(sequence) - 6)) AS i FROM passed))
      SELECT record_index, CAST(count(DISTINCT k) AS BIGINT) AS n_words, min(k) AS first_word FROM w WHERE NOT regexp_matches(k, '[^ACGT]') GROUP BY 1""",
    "embedding_health": f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), l AS (SELECT unnest(e) AS x, unnest(range(len(e))) AS d FROM v), g AS (SELECT d, min(x) AS lo, max(x) AS hi FROM l GROUP BY d)
      SELECT (SELECT CAST(count(*) AS BIGINT) FROM v) AS rows, (SELECT CAST(count(*) AS BIGINT) FROM g) AS dim, count(*) FILTER (WHERE isnan(x) OR isinf(x)) = 0 AS finite, CAST(count(*) FILTER (WHERE isnan(x)) AS BIGINT) AS n_nan, CAST(count(*) FILTER (WHERE isinf(x)) AS BIGINT) AS n_inf,
      {rnd('avg(x)')} AS mean, {rnd('stddev_pop(x)')} AS std, {rnd('min(x)')} AS min, {rnd('max(x)')} AS max, (SELECT CAST(count(*) AS BIGINT) FROM g WHERE lo = hi) AS dead_dims, (SELECT {rnd('avg(sqrt(list_dot_product(e, e)))')} FROM v) AS mean_l2_norm FROM l""",
    "standardize": f"""WITH l AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS d FROM embeddings)
      SELECT vec_id, CAST(d AS BIGINT) AS d, {rnd('(x - avg(x) OVER (PARTITION BY d)) / CASE WHEN stddev_pop(x) OVER (PARTITION BY d) = 0 THEN 1 ELSE stddev_pop(x) OVER (PARTITION BY d) END', 5)} AS x FROM l""",
    "l2_normalize": f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), l AS (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS d, sqrt(list_dot_product(e, e)) AS n FROM v)
      SELECT vec_id, CAST(d AS BIGINT) AS d, {rnd('x / CASE WHEN n = 0 THEN 1 ELSE n END', 5)} AS x FROM l""",
    "cosine_topk": f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, neighbour) AS rank FROM p) SELECT vec_id, neighbour, {rnd('s', 5)} AS similarity, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5""",
    "knn_jaccard": f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS o, list_cosine_similarity(a.e, b.e) AS s, list_cosine_similarity(a.e[1:32], b.e[1:32]) AS t FROM v a JOIN v b ON a.vec_id <> b.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, o) AS rs, row_number() OVER (PARTITION BY vec_id ORDER BY round(t, 12) DESC, o) AS rt FROM p)
      SELECT vec_id, {rnd('CAST(count(*) FILTER (WHERE rs <= 20 AND rt <= 20) AS DOUBLE) / count(*) FILTER (WHERE rs <= 20 OR rt <= 20)')} AS jaccard FROM r GROUP BY vec_id""",
    "mate_retrieval": f"WITH {retrieved()} SELECT pair_id, rank, {rnd('mate')} AS mate_similarity FROM rq",
    "retrieval_summary": retrieval_row(),
    "mate_retrieval_uncontrolled": retrieval_row(controlled=False),
    "retrieval_auroc": auroc_row(),
    "mcnemar": f"""WITH fa AS (WITH {retrieved()} SELECT pair_id, rank <= 5 AS hit FROM rq), fb AS (WITH {retrieved(32)} SELECT pair_id, rank <= 5 AS hit FROM rq),
      t AS (SELECT count(*) AS n, count(*) FILTER (WHERE fa.hit AND NOT fb.hit) AS a, count(*) FILTER (WHERE NOT fa.hit AND fb.hit) AS b, count(*) FILTER (WHERE fa.hit IS NULL OR fb.hit IS NULL) AS u FROM fa FULL JOIN fb USING (pair_id)),
      x AS (SELECT *, CAST(a - b AS DOUBLE) / n AS d, 1.96 * sqrt(a + b) / n AS h FROM t)
      SELECT CAST(n AS BIGINT) AS n, CAST(a AS BIGINT) AS only_a, CAST(b AS BIGINT) AS only_b, CAST(u AS BIGINT) AS unmatched, {rnd('d')} AS difference, {rnd('d - h')} AS ci95_lower, {rnd('d + h')} AS ci95_upper FROM x""",
    "mcnemar_exact": f"""WITH fa AS (WITH {retrieved()} SELECT pair_id, rank <= 5 AS hit FROM rq), fb AS (WITH {retrieved(32)} SELECT pair_id, rank <= 5 AS hit FROM rq),
      t AS (SELECT CAST(count(*) FILTER (WHERE fa.hit AND NOT fb.hit) AS BIGINT) AS a, CAST(count(*) FILTER (WHERE NOT fa.hit AND fb.hit) AS BIGINT) AS b FROM fa JOIN fb USING (pair_id)),
      u AS (SELECT a, b, unnest(range(greatest(a, b), a + b + 1)) AS i FROM t), p AS (SELECT least(1, 2 * sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2)))) AS p FROM u)
      SELECT a AS only_a, b AS only_b, CASE WHEN a + b > 0 THEN {rnd('p')} END AS p_value, CASE WHEN a + b = 0 THEN 'no discordant queries' WHEN p >= 0.05 THEN 'not significant' WHEN a > b THEN 'first better' ELSE 'second better' END AS verdict FROM t, p""",
    "encoder_comparison": f"""WITH fa AS ({retrieval_row(32)}), fb AS ({retrieval_row()}), m AS (SELECT unnest(['top1_accuracy', 'top5_accuracy', 'mean_reciprocal_rank']) AS metric, unnest([fa.top1_accuracy, fa.top5_accuracy, fa.mean_reciprocal_rank]) AS baseline,
      unnest([fb.top1_accuracy, fb.top5_accuracy, fb.mean_reciprocal_rank]) AS foundation FROM fa, fb) SELECT *, CASE WHEN abs(baseline - foundation) <= 1e-6 THEN 'tie' WHEN baseline > foundation THEN 'baseline' ELSE 'foundation' END AS winner FROM m""",
    "encoder_head_to_head": head_to_head(),
    "nb_fit": f"WITH {WORDS} SELECT word, lang AS label, {rnd('log_prior')} AS log_prior, {rnd('gain')} AS gain FROM gw",
    "nb_class_sizes": f"WITH {WORDS} SELECT CAST(count(*) AS BIGINT) AS n_classes, CAST(sum(n) AS BIGINT) AS n_reference, min(n) AS smallest, max(n) AS largest, CAST(median(n) AS DOUBLE) AS median, CAST(count(*) FILTER (WHERE n = 1) AS BIGINT) AS classes_with_one_reference FROM cl",
    "nb_classify": f"WITH {WORDS} SELECT doc_id, predicted FROM pd",
    "nb_bootstrap": f"WITH {BOOT} SELECT doc_id, predicted, votes, confidence, assigned FROM bt",
    "assignment_summary": f"""WITH {BOOT}, x AS (SELECT bt.*, d.n_chars FROM bt JOIN documents d USING (doc_id))
      SELECT CAST(count(*) AS BIGINT) AS n_queries, CAST(count(*) FILTER (WHERE assigned) AS BIGINT) AS n_assigned, CAST(count(*) FILTER (WHERE NOT assigned) AS BIGINT) AS n_unassigned, {rnd('avg(CAST(assigned AS INTEGER))')} AS assignment_rate,
      CAST(count(DISTINCT predicted) FILTER (WHERE assigned) AS BIGINT) AS n_distinct_classes, {rnd('avg(confidence)')} AS mean_confidence, {rnd('median(confidence)')} AS median_confidence,
      list_transform(quantile_cont(confidence, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]), lambda v: {rnd('v', 4)}) AS confidence_deciles,
      {rnd('CAST(sum(n_chars) FILTER (WHERE assigned) AS DOUBLE) / sum(n_chars)')} AS read_assignment_rate FROM x""",
    "nb_cross_validation": f"""WITH {FOLDS} SELECT CAST(fold AS INTEGER) AS fold, CAST(count(*) AS BIGINT) AS n, {rnd('avg(CAST(correct AS INTEGER))')} AS accuracy,
      {rnd('avg(confidence) FILTER (WHERE correct)')} AS confidence_correct, {rnd('avg(confidence) FILTER (WHERE NOT correct)')} AS confidence_wrong FROM fv GROUP BY fold""",
    "label_silhouettes": f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT vec_id, label, g, CASE WHEN g = 0 THEN label ELSE label % 2 END AS c, v FROM e, range(2) r(g)),
      d AS (SELECT a.vec_id AS id, a.label, a.g, a.c = b.c AS own, b.c, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM c a JOIN c b ON a.g = b.g GROUP BY ALL),
      m AS (SELECT id, label, g, max(s / greatest(n - 1, 1)) FILTER (WHERE own) AS a, max(n) FILTER (WHERE own) AS n, min(s / n) FILTER (WHERE NOT own) AS b FROM d GROUP BY ALL),
      z AS (SELECT *, CASE WHEN n > 1 AND b IS NOT NULL AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END AS s FROM m)
      SELECT label, CAST(count(DISTINCT id) AS BIGINT) AS n, {rnd('avg(s) FILTER (WHERE g = 0)', 5)} AS by_label, {rnd('avg(s) FILTER (WHERE g = 1)', 5)} AS by_half FROM z GROUP BY label""",
    "top_classes": f"WITH {BOOT} SELECT predicted, CAST(count(*) AS BIGINT) AS n FROM bt WHERE assigned GROUP BY 1 ORDER BY n DESC, predicted LIMIT 15",
    "reference_windows": f"WITH {REFERENCE} SELECT rd.accession, sequence, taxonomy, {RANK_COLUMNS} FROM rd JOIN rl USING (accession) WHERE length(sequence) >= 100 AND taxonomy <> ''",
    "lineage_ranks": f"WITH {REFERENCE} SELECT accession, {RANK_COLUMNS} FROM rl",
    "rank_counts": f"""WITH {REFERENCE}, x AS (SELECT {RANK_COLUMNS} FROM rd JOIN rl USING (accession) WHERE length(sequence) >= 100 AND taxonomy <> '')
      {" UNION ALL ".join(f"SELECT '{r}' AS rank, CAST(count(DISTINCT nullif({chr(34)}{r}{chr(34)}, '')) AS BIGINT) AS n FROM x" for r in RANK_NAMES)}""",
    "class_breakdown": f"WITH {REFERENCE} SELECT coalesce(l[2], '') AS supergroup, CAST(count(*) AS BIGINT) AS n FROM rd JOIN rl USING (accession) WHERE length(sequence) >= 100 AND taxonomy <> '' GROUP BY 1",
    "label_header_scan": f"WITH {READS}, x AS (SELECT * FROM reads ORDER BY record_index LIMIT 20000) SELECT CAST(count(*) AS BIGINT) AS headers, CAST(count(*) FILTER (WHERE regexp_matches(header, '{TAXONOMY_HINT}')) AS BIGINT) AS with_hint FROM x",
    "min_class_filter": "SELECT doc_id, lang FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 120)",
    "dropped_classes": "SELECT lang FROM documents GROUP BY lang HAVING count(*) < 120",
    "stratified_split": """WITH x AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY CAST(concat('0x', substring(md5(concat('split:42:', vec_id)), 1, 15)) AS BIGINT), vec_id) AS r FROM embeddings),
      y AS (SELECT *, CAST(round_even(CAST(0.7 AS DOUBLE) * n, 0) AS BIGINT) AS a, CAST(round_even(CAST(0.15 AS DOUBLE) * n, 0) AS BIGINT) AS b FROM x) SELECT vec_id, label, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'val' ELSE 'test' END AS split FROM y""",
    "classification_metrics": f"""WITH {SCORED} SELECT {rnd('CAST(sum(h) AS DOUBLE) / sum(t)')} AS accuracy, {rnd('avg(pre)')} AS macro_precision, {rnd('avg(rec)')} AS macro_recall, {rnd('avg(f1)')} AS macro_f1, {rnd('sum(f1 * t) / sum(t)')} AS weighted_f1,
      CAST(sum(t) AS BIGINT) AS n_test, CAST(count(*) AS BIGINT) AS n_classes FROM pm""",
    "per_class_metrics": f"WITH {SCORED} SELECT class, {rnd('pre')} AS precision, {rnd('rec')} AS recall, {rnd('f1')} AS f1, CAST(t AS BIGINT) AS support FROM pm",
    "confusion_matrix_norm": f"WITH {SCORED} SELECT truth, predicted, CAST(count(*) AS BIGINT) AS n, {rnd('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY truth)')} AS share FROM sl GROUP BY 1, 2",
    "calibration_bins": f"""WITH {SCORED}, x AS (SELECT CAST(ceil(confidence * 15) AS BIGINT) AS bin, count(*) AS n, avg(confidence) AS c, avg(CAST(correct AS INTEGER)) AS a FROM sl WHERE confidence > 0 GROUP BY 1)
      SELECT CAST(g.b AS BIGINT) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS count, {rnd('c')} AS mean_confidence, {rnd('a')} AS accuracy FROM range(1, 16) AS g(b) LEFT JOIN x ON x.bin = g.b""",
    "calibration_summary": f"""WITH {SCORED}, x AS (SELECT sum(abs(c - a)) AS gap FROM (SELECT sum(confidence) AS c, sum(CAST(correct AS INTEGER)) AS a FROM sl GROUP BY ceil(confidence * 15)))
      SELECT CAST(count(*) AS BIGINT) AS n, {rnd('avg(confidence)')} AS mean_confidence, {rnd('median(confidence)')} AS median_confidence, {rnd('avg(2 * (p - truth) * (p - truth))')} AS brier_score, {rnd('(SELECT gap FROM x) / count(*)')} AS expected_calibration_error,
      CAST(count(*) FILTER (WHERE confidence >= 0.9) AS BIGINT) AS high, CAST(count(*) FILTER (WHERE confidence >= 0.7 AND confidence < 0.9) AS BIGINT) AS medium, CAST(count(*) FILTER (WHERE confidence < 0.7) AS BIGINT) AS low FROM sl""",
    "cluster_profile": f"""WITH {CLUSTERED}, g AS (SELECT cluster, CAST(count(*) AS BIGINT) AS n_variants, CAST(sum(n) AS BIGINT) AS n_reads, {rnd('avg(gcv) * 100', 3)} AS mean_gc, {rnd('stddev_pop(gcv) * 100', 3)} AS sd_gc, CAST(max(n) AS BIGINT) AS top_variant_reads FROM cv GROUP BY 1),
      ec AS (SELECT cluster, "end", count(*) AS k FROM cv WHERE "end" >= 0 GROUP BY ALL), ed AS (SELECT cluster, "end", k, sum(k) OVER (PARTITION BY cluster) AS s, row_number() OVER (PARTITION BY cluster ORDER BY k DESC, "end") AS rr FROM ec)
      SELECT g.*, CAST(ed."end" AS INTEGER) AS dominant_end, {rnd('CAST(k AS DOUBLE) / s', 4)} AS end_purity, {rnd('CAST(n_variants AS DOUBLE) / sum(n_variants) OVER ()')} AS variant_share, {rnd('CAST(n_reads AS DOUBLE) / sum(n_reads) OVER ()')} AS read_share FROM g LEFT JOIN ed ON ed.cluster = g.cluster AND rr = 1""",
    "variance_explained": f"WITH {CLUSTERED} SELECT {explained('gcv')} AS gc, {explained('log10(n + 1)')} AS log_abundance",
    "adjusted_rand": agreement("SELECT label AS a, vec_id // 7 % 10 AS b FROM embeddings"),
    "fowlkes_mallows": agreement("SELECT lang AS a, source AS b FROM documents"),
    "adjusted_mutual_information": f"""WITH c AS (SELECT lang, source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY ALL), a AS (SELECT lang, sum(n) AS x FROM c GROUP BY 1), b AS (SELECT source, sum(n) AS y FROM c GROUP BY 1),
      t AS (SELECT sum(n) AS n, sum(n * ln(n)) AS joint FROM c), s AS (SELECT t.n, ln(t.n) - (SELECT sum(x * ln(x)) FROM a) / t.n AS ha, ln(t.n) - (SELECT sum(y * ln(y)) FROM b) / t.n AS hb, ln(t.n) - joint / t.n AS hab FROM t),
      k AS (SELECT x, y, n, unnest(range(CAST(greatest(1, x + y - n) AS BIGINT), CAST(least(x, y) AS BIGINT) + 1)) AS i FROM a, b, t),
      e AS (SELECT sum(i / n * ln(n * i / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(i + 1) - lgamma(x - i + 1) - lgamma(y - i + 1) - lgamma(n - x - y + i + 1))) AS e FROM k)
      SELECT {rnd('(ha + hb - hab - e) / ((ha + hb) / 2 - e)')} AS ami FROM s, e""",
    "cost_projection": f"SELECT CAST(count(*) AS BIGINT) AS reads, {rnd('count(*) / CAST(15000 AS DOUBLE)')} AS projected_seconds, CAST(count(*) * 136 * 4 AS BIGINT) AS storage_bytes FROM events",
    "abundance_marker_size": f"WITH {VARIANTS}, t AS (SELECT * FROM vt WHERE variant_id < 20000) SELECT variant_id, {rnd('3 + 260 * sqrt(CAST(n AS DOUBLE) / max(n) OVER ())')} AS size FROM t",
}
