"""Texts, lines and windows as queries over the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FNV_BASIS, FNV_BASIS_ARTIFACT, FNV_PRIME, KEYWORDS, TOKEN, anchor, fnv1a64, is_defect_subject, layer, outcome_kinds, path_module_key, safe_name, title, version_triple
from ..functions.scores import halstead
from ..operators import clones as C
from ..operators.ranking import ranked, ranking_metrics
from ..operators.windows import carry_forward, group_numbers, islands, occurrence
from ..sources.rust_text import functions_of, functions_sql, halstead_counts
from ..tables import load
from .measures import _modules
from .relations import _OWN_SQL


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").filter(F.col("source") == "source_file").select("doc_id", "text")


def source_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of the source files by their lines alone, with pressure counts and complexities."""
    return functions_of(_sources(spark, sf_dir), "doc_id", "text")


def source_halstead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume, difficulty and effort of each source file from its tokens."""
    n = halstead_counts(_sources(spark, sf_dir), "doc_id", "text")
    h = halstead(F.col("operators"), F.col("operands"), F.col("total_operators"), F.col("total_operands"))
    return n.select("*", h.alias("h")).select(*n.columns, F.round("h.volume", 6).alias("volume"), F.round("h.difficulty", 6).alias("difficulty"), F.round("h.effort", 3).alias("effort"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 normalised tokens inside functions of source files."""
    files = _sources(spark, sf_dir)
    return C.within_functions(C.file_windows(files, "doc_id", "text"), "doc_id", source_functions(spark, sf_dir))


def token_clone_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 normalised tokens inside functions that occur more than once among source files."""
    return C.window_groups(_windows(spark, sf_dir), "doc_id")


def clone_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint instances of each repeated window, chosen greedily."""
    return C.disjoint_instances(_windows(spark, sf_dir), "doc_id").drop("at")


def clone_groups_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _sources(spark, sf_dir)
    return C.coalesce_groups(C.disjoint_instances(_windows(spark, sf_dir), "doc_id"), "doc_id", files, "text")


def clone_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, duplicated nonblank lines and their share of all source lines."""
    files = _sources(spark, sf_dir)
    rows, instances = C.clone_rows(clone_groups_coalesced(spark, sf_dir), "doc_id", files, "text")
    return C.clone_summary(rows, instances, "doc_id", files, "text")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line of the documents: doc_id, line (from 1), content."""
    docs = load(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("_i", "content")).select("doc_id", "source", (F.col("_i") + 1).cast("bigint").alias("line"), "content")


def duplicated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nonblank lines of each source file covered by any repeated window inside a function, counted once."""
    windows = _windows(spark, sf_dir)
    repeated = windows.join(C.window_groups(windows, "doc_id").select("window_hash"), "window_hash", "left_semi").select("doc_id", "first_line", "last_line").distinct()
    return C.duplicated_lines(C.with_line_counts(repeated, "doc_id", _sources(spark, sf_dir), "text"), "doc_id")


def equal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose white-space-collapsed text occurs twice or more over at least five lines."""
    docs = load(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    bodies = docs.select("doc_id", F.md5(anchor(F.col("text"))).alias("body"), F.lit(1).cast("bigint").alias("s"), F.size(F.split("text", "\n")).cast("bigint").alias("e"))
    return C.equal_bodies(bodies, "body", "doc_id", "s", "e")


def responsibility_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules with one signature of target kind, entrypoint, and counts."""
    own = _modules(spark, sf_dir).filter((F.col("parse_status") == "ok") & (F.col("source_nonblank_line_count") >= 8) & ((F.col("public_api_count") >= 2) | (F.col("function_count") >= 3)))
    signature = F.concat_ws("|", F.coalesce("target_kind", F.lit("-")), F.coalesce("entrypoint_kind", F.lit("-")), F.col("public_api_count").cast("string"), F.col("function_count").cast("string"))
    return C.equal_responsibilities(own.withColumn("signature", signature), "signature", "public_api_count", "function_count")


def clone_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clones of all engines under one schema: token rows, equal bodies of functions (of test files apart) and responsibilities, summed by engine."""
    files = _sources(spark, sf_dir)
    token, _ = C.clone_rows(clone_groups_coalesced(spark, sf_dir), "doc_id", files, "text")
    spans = source_functions(spark, sf_dir)
    text = files.select(F.col("doc_id").alias("_d"), F.split("text", "\n").alias("_lines"))
    body = F.array_join(F.slice("_lines", F.col("start_line").cast("int") + 1, (F.col("end_line") - F.col("start_line")).cast("int")), "\n")
    bodies = spans.join(text, F.col("doc_id") == F.col("_d")).select("doc_id", "start_line", "end_line", F.md5(anchor(body)).alias("body"), (F.col("branch_pressure") == 0).alias("flat"))
    equal = lambda df, test: C.equal_bodies(df, "body", "doc_id", "start_line", "end_line", test)
    whole = C.all_engines(token, equal(bodies.filter(~F.col("flat")), False), responsibility_groups(spark, sf_dir), equal(bodies.filter("flat"), True))
    return whole.groupBy("engine").agg(F.count("*").alias("n_rows"), F.sum("instance_count").alias("n_instances"), F.sum(F.col("score").cast("decimal(30,2)")).cast("double").alias("score"))


def line_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive start lines of each module's scopes."""
    return islands(load(spark, sf_dir, "lexical").select("module_key", "start_line"), ["module_key"], "start_line")


def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under each heading (starting with #) of runbooks, changelogs and docs, by carrying headings forward."""
    lines = _lines(spark, sf_dir).filter(F.col("source").isin("runbook", "changelog", "rustdoc"))
    heading = F.col("content").startswith("#")
    lines = lines.withColumn("heading", F.when(heading, F.col("content")))
    numbered = group_numbers(carry_forward(lines, ["doc_id"], "line", "heading", "under"), ["doc_id"], "line", heading, "section")
    return numbered.groupBy("doc_id", "section", "under").agg(F.count("*").alias("n_lines"), F.sum(F.length("content")).cast("bigint").alias("n_chars"))


def line_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals of equal lines (white space aside) within a document: the highest of each document."""
    lines = _lines(spark, sf_dir).withColumn("key", anchor(F.col("content"))).filter("key <> ''")
    return occurrence(lines, ["doc_id", "key"], ["line"], "n").groupBy("doc_id").agg(F.max("n").cast("bigint").alias("most"), F.count_if(F.col("n") > 1).alias("repeats"))


def subject_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits by kind of outcome and whether the subject speaks of a defect, with whole words."""
    return load(spark, sf_dir, "history").select(F.coalesce(is_defect_subject(F.col("subject")), F.lit(False)).alias("defect"), F.coalesce(F.array_join(outcome_kinds(F.col("subject")), "+"), F.lit("")).alias("kinds")).groupBy("defect", "kinds").agg(F.count("*").alias("n"))


def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made from paths: layer, module key, safe file name and title."""
    own = _modules(spark, sf_dir)
    return own.select("module_id", layer(F.col("path")).alias("layer"), path_module_key(F.col("path")).alias("key"), safe_name(F.col("module_id")).alias("safe"), title(F.col("module_id")).alias("title"))


def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest tool version of each project by its numbers, the last report that has it, and how many texts are no version."""
    p = load(spark, sf_dir, "practices").withColumn("v", version_triple(F.col("tool_version")))
    best = F.max(F.when(F.col("v").isNotNull(), F.struct("v", "report_id")))
    return p.groupBy("project_key").agg(best.alias("b"), F.count_if(F.col("v").isNull()).alias("unreadable")).select("project_key", F.concat_ws(".", "b.v.major", "b.v.minor", "b.v.patch").alias("latest"), F.col("b.report_id").alias("report_id"), "unreadable")


def rank_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well length ranks the documents reviewed as toxic, by source."""
    labels = load(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_d")).agg(F.max("toxic").alias("toxic"))
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", (-F.col("n_chars")).alias("score")).join(labels, F.col("doc_id") == F.col("_d"))
    rows = ranked(docs.withColumn("relevant", F.col("toxic") == 1), ["source"], "score", "doc_id")
    found = ranking_metrics(rows, ["source"], "relevant")
    return found.select("source", "n_ranked", "n_relevant", *(F.round(c, 6).alias(c) for c in ("precision_at_top", "recall_at_top", "mean_percentile_rank", "quarter_lift")), "status")


def fnv_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable hashes of names with both offset bases."""
    own = _modules(spark, sf_dir).select("module_id")
    return own.select("module_id", fnv1a64(FNV_BASIS)("module_id").alias("helper_hash"), fnv1a64(FNV_BASIS_ARTIFACT)("module_id").alias("artifact_hash"))


QUERIES = {f.__name__: f for f in (
    source_functions, source_halstead, token_clone_groups, clone_instances, clone_groups_coalesced, clone_summary, clone_engines, duplicated_lines, equal_texts, responsibility_groups, line_islands, running_headers, line_occurrences, subject_outcomes, path_names, latest_versions, rank_validation, fnv_names,
)}

_WORDS_SQL = ",".join(f"'{w}'" for w in KEYWORDS)
_TOKENS_SQL = rf"""{functions_sql("documents", "doc_id", "text").replace("from documents where", "from documents where source = 'source_file' and")},
f as (select doc_id, text from documents where source = 'source_file' and text is not null),
ln as (select doc_id, unnest(string_split(text, chr(10))) c, unnest(range(1, len(string_split(text, chr(10))) + 1)) l from f),
tk as (select doc_id, l, unnest(regexp_extract_all(c, '{TOKEN}')) t, unnest(range(len(regexp_extract_all(c, '{TOKEN}')))) i from ln),
nt as (select doc_id, l, row_number() over (partition by doc_id order by l, i) p, case when t in ({_WORDS_SQL}) then t when regexp_matches(t, '^[0-9]+$') then 'LIT' when regexp_matches(t, '^[A-Za-z_]') then 'ID' else t end t from tk),
w as (select doc_id, p - 1 as at_, md5(string_agg(t, '|') over x) window_hash, l first_line, max(l) over x last_line, count(*) over x n from nt window x as (partition by doc_id order by p rows between current row and 49 following)),
win as (select * from w where n = 50 and last_line - first_line + 1 >= 3 and exists (select 1 from rfn where rfn.doc_id = w.doc_id and start_line <= first_line and last_line <= end_line)),
grp as (select window_hash, count(*) n_windows, count(distinct doc_id) n_files, max(last_line - first_line + 1) span, 5.0::double * count(*) score from win group by 1 having count(*) >= 2)"""
_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL = {
    "token_clone_groups": f"with {_TOKENS_SQL} select * from grp",
    "source_functions": f"with {_TOKENS_SQL} select * from rfn",
    "source_halstead": f"""
with f as (select doc_id, unnest(regexp_extract_all(text, '{TOKEN}')) t from documents where source = 'source_file' and text is not null), e as (select doc_id, t, count(*) n, regexp_matches(t, '^[A-Za-z_\\p{{Nd}}]') and t not in ({_WORDS_SQL}) o from f group by 1, 2),
g as (select doc_id, count(*) filter (where not o) operators, count(*) filter (where o) operands, coalesce(sum(n) filter (where not o), 0)::bigint total_operators, coalesce(sum(n) filter (where o), 0)::bigint total_operands from e group by 1),
v as (select *, (total_operators + total_operands) * log2((operators + operands)::double) v, case when operands > 0 then operators::double / 2 * (total_operands::double / operands) end d from g)
select doc_id, operators, operands, total_operators, total_operands, round(v, 6) volume, round(d, 6) difficulty, round(d * v, 3) effort from v""",
    "clone_instances": f"""
with recursive {_TOKENS_SQL}, rep as (select window_hash, doc_id, min({{'s': first_line, 'e': last_line}}) x from win join grp using (window_hash) group by all),
pick as (
  select window_hash, doc_id, x from rep
  union all
  select win.window_hash, win.doc_id, min({{'s': first_line, 'e': last_line}}) x from pick join win on win.window_hash = pick.window_hash and win.doc_id = pick.doc_id and first_line > pick.x.e group by 1, 2
) select doc_id, window_hash, x.s first_line, x.e last_line from pick where window_hash in (select window_hash from pick group by 1 having count(*) >= 2)""",
    "duplicated_lines": f"with {_TOKENS_SQL} select doc_id, count(distinct l) n_lines from (select doc_id, unnest(range(first_line, last_line + 1)) l from win join grp using (window_hash)) join ln using (doc_id, l) where trim(regexp_replace(c, '{_WS}+', ' ', 'g')) <> '' group by 1",
    "equal_texts": f"""
select body, count(*) n, count(distinct doc_id) n_files, max(e) span, count(*) * max(e) * 1.5::double score
from (select doc_id, md5(trim(regexp_replace(text, '{_WS}+', ' ', 'g'))) body, len(string_split(text, chr(10))) e from documents where text is not null) group by 1 having count(*) >= 2 and max(e) >= 5""",
    "responsibility_groups": f"""
with {_OWN_SQL} select concat_ws('|', coalesce(target_kind, '-'), coalesce(entrypoint_kind, '-'), public_api_count, function_count) signature, count(*) n, max(public_api_count) max_api, max(function_count) max_functions, count(*) * (8.0::double + max(public_api_count) + 1.5::double * max(function_count)) score
from own where parse_status = 'ok' and source_nonblank_line_count >= 8 and (public_api_count >= 2 or function_count >= 3) group by 1 having count(*) >= 2""",
    "line_islands": """
select module_key, min(x) "first", max(x) "last", count(*) n from (select module_key, x, x - row_number() over (partition by module_key order by x) g from (select distinct module_key, start_line x from lexical where start_line is not null)) group by module_key, g""",
    "running_headers": """
with ln as (select doc_id, unnest(string_split(text, chr(10))) c, unnest(range(len(string_split(text, chr(10))))) l from documents where text is not null and source in ('runbook', 'changelog', 'rustdoc')),
s as (select *, sum((c like '#%')::int) over (partition by doc_id order by l) section, last_value(case when c like '#%' then c end ignore nulls) over (partition by doc_id order by l) under from ln)
select doc_id, section::bigint section, under, count(*) n_lines, sum(length(c))::bigint n_chars from s group by all""",
    "line_occurrences": f"""
with ln as (select doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '{_WS}+', ' ', 'g')) k from documents where text is not null), g as (select doc_id, k, count(*) n from ln where k <> '' group by all)
select doc_id, max(n) most, sum(n - 1)::bigint repeats from g group by 1""",
    "subject_outcomes": r"""
with s as (select regexp_split_to_array(lower(subject), '[^\p{L}\p{N}]+') w, lower(subject) s from history)
select coalesce(list_has_any(w, ['bug','bugs','bugfix','fix','fixes','fixed','defect','defects','regression','regressions','panic','crash']), false) defect,
  concat_ws('+', case when list_has_any(w, ['bug','bugfix','defect','fix','fixed','panic','crash','regression']) then 'defect' end, case when list_has_any(w, ['revert','rollback']) then 'revert' end, case when list_has_any(w, ['security','vulnerability']) or contains(s, 'cve-') or contains(s, 'rustsec-') then 'security' end) kinds, count(*) n from s group by all""",
    "path_names": None,
    "latest_versions": r"""
with v as (select project_key, report_id, string_split(regexp_split_to_array(regexp_replace(trim(tool_version), '^rustc ', ''), '[- ]')[1], '.') t from practices),
n as (select project_key, report_id, case when try_cast(t[1] as bigint) >= 0 then [try_cast(t[1] as bigint), coalesce(try_cast(t[2] as bigint), 0), coalesce(try_cast(t[3] as bigint), 0)] end v from v)
select project_key, coalesce(array_to_string(max(v), '.'), '') latest, max(case when v is not null then {'v': v, 'r': report_id} end).r report_id, count(*) filter (where v is null) unreadable from n group by 1""",
    "rank_validation": """
with l as (select doc_id, max(toxic) toxic from labels group by 1), d as (select source, toxic = 1 hit, row_number() over (partition by source order by -n_chars desc nulls last, doc_id) - 1 p, count(*) over (partition by source) n from documents join l using (doc_id)),
g as (select source, any_value(n) n, count(*) filter (where hit) k, count(*) filter (where hit and p < 10) t, sum(case when hit then (case when n = 1 then 100.0::double else (1 - p::double / (n - 1)) * 100 end)::decimal(30,10) end)::double r, count(*) filter (where hit and p < greatest(ceil(n / 4.0), 1)) q, max(greatest(ceil(n / 4.0), 1)) qn from d group by 1)
select source, n n_ranked, k n_relevant, round(case when k > 0 then t::double / least(n, 10) end, 6) precision_at_top, round(t::double / nullif(k, 0), 6) recall_at_top, round(r / nullif(k, 0), 6) mean_percentile_rank, round((q::double / nullif(k, 0)) / (qn::double / n), 6) quarter_lift, case when k = 0 then 'no-labels' else 'validated' end status from g""",
}
from .relations import _LAYER_SQL  # noqa: E402

SQL["path_names"] = f"""
with {_OWN_SQL}, p as (select *, list_filter(regexp_split_to_array(module_id, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w not in ('', 'test', 'should', 'when')) t from own)
select module_id, {_LAYER_SQL('path')} layer, case when path like 'src/%' then replace(regexp_replace(regexp_replace(substring(path, 5), '(\\.rs)+$', ''), '(/mod)+$', ''), '/', '::') else regexp_replace(regexp_replace(path, '^.*/', ''), '(.)\\.[^.]*$', '\\1') end "key",
  regexp_replace(module_id, '[^A-Za-z0-9_-]', '_', 'g') safe, 'Checks ' || case when len(t) > 0 then array_to_string(list_slice(t, 1, 7), ' ') else 'behavior' end || '.' title from p"""

_FNV_SQL = lambda basis: f"""lpad(lower(hex(list_reduce([{basis}::uhugeint] || list_transform(string_split(module_id, ''), lambda c: ascii(c)::uhugeint), lambda h, c: (xor(h, c) * {FNV_PRIME}::uhugeint) % 18446744073709551616::uhugeint)::ubigint)), 16, '0')"""
SQL["fnv_names"] = f"with {_OWN_SQL} select module_id, {_FNV_SQL(FNV_BASIS)} helper_hash, {_FNV_SQL(FNV_BASIS_ARTIFACT)} artifact_hash from own"
