"""The queries of this subpackage, one for each operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.llm import classlm, decontaminate, fingerprints, langid, licenses, linededup, mixing, neardup, suffixes, tokens
from sonolith.llm.common import table


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at four words a shingle, as its contract says."""
    return neardup.groups(table(spark, sf_dir, "documents"), shingle=4)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return found.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed_lines", "line_dedup.n_removed_chunks", kept.alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source/thousand/hundred/id.txt, the first of a hundred named LICENSE, the first of a thousand one directory above."""
    docs = table(spark, sf_dir, "documents")
    at = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    under = F.concat_ws("/", F.coalesce("source", F.lit("none")), at(1000))
    path = F.when(F.col("doc_id") % 1000 == 0, F.concat_ws("/", under, F.lit("LICENSE"))).when(F.col("doc_id") % 100 == 0, F.concat_ws("/", under, at(100), F.lit("LICENSE")))
    path = path.otherwise(F.concat_ws("/", under, at(100), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return licenses.scan(docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.read_pieces())


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classlm.fit_and_score(table(spark, sf_dir, "documents"), ~langid.held_out(fold=2, folds=7))
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents")).drop("removed")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_near_dedup, op3_language_id, op4_license_scan, op5_decontamination, op6_mixing, op7_token_counts, op8_class_lm, op9_suffix_dedup, op10_fingerprints)}
_WORDS = "list_filter(regexp_split_to_array(coalesce({text}, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(rows: str, key: str, k: int) -> str:
    """SQL of the distinct shingles of rows(key, w)."""
    return f"""select distinct {key}, unnest(case when len(w) = 0 then [] when len(w) < {k} then [array_to_string(w, ' ')]
        else list_transform(generate_series(1, len(w) - {k - 1}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) end) as s from {rows}"""


def _license_sql() -> str:
    """Scores every unit, without any bound, and walks all ancestors."""
    weights, unknown = licenses.template_weights()
    rows = ", ".join(f"({f}, '{n}', '{t}', {w!r}::double, {i!r}::double)" for f, n, t, w, i in weights)
    islands = lambda kind, inside: f"""select doc_id, '{kind}' as kind, min(line) as first, count(*) as n_lines, flatten(list(terms order by line)) as terms
        from (select *, line - row_number() over (partition by doc_id order by line) as g from l where {inside}) group by doc_id, g having count(*) > 1"""  # noqa: E731
    named = f"regexp_matches(path, '{licenses.LICENSE_FILE}')"
    return f"""with tw(form, license, term, weight, idf) as (values {rows}), idf as (select term, max(idf) as idf from tw group by 1),
        p as (select doc_id, text, coalesce(source, 'none') || '/' || cast(floor(doc_id / 1000) as bigint) as under, cast(floor(doc_id / 100) as bigint)::varchar as h from documents),
        f as (select doc_id, text, under || case when doc_id % 1000 = 0 then '/LICENSE' when doc_id % 100 = 0 then '/' || h || '/LICENSE' else '/' || h || '/' || doc_id || '.txt' end as path from p),
        a as (select doc_id, string_split(lower(coalesce(text, '')), chr(10)) as ls from f), x as (select doc_id, unnest(ls) as body, unnest(generate_series(0, len(ls) - 1)) as line from a),
        l as (select doc_id, line, regexp_extract_all(body, '{licenses.TERM}') as terms, regexp_matches(body, '{licenses.COMMENT}') as comment from x),
        u as (select doc_id, 'line' as kind, line as first, 1 as n_lines, terms from l union all {islands("paragraph", "len(terms) > 0")} union all {islands("comment", "comment")}
            union all select l.doc_id, 'file', 0, count(*), flatten(list(terms order by line)) from l join f on f.doc_id = l.doc_id where {named} group by 1),
        t as (select doc_id, kind, first, len(terms) as n_terms, unnest(terms) as term from u), k as (select doc_id, kind, first, n_terms, term, count(*) as n from t group by all),
        w as (select k.*, (1 + ln(n)) * coalesce(idf.idf, {unknown!r}::double) as w from k left join idf on idf.term = k.term), nrm as (select doc_id, kind, first, sqrt(sum(w * w)) as norm from w group by 1, 2, 3),
        cs as (select w.doc_id, w.kind, w.first, w.n_terms, form, license, round(sum(w.w * tw.weight) / max(norm), 9) as score from w join tw on tw.term = w.term join nrm on nrm.doc_id = w.doc_id and nrm.kind = w.kind and nrm.first = w.first group by 1, 2, 3, 4, 5, 6),
        b as (select doc_id, kind, first, n_terms, max(score) as score, arg_min(license, (-score, license)) as license from cs group by 1, 2, 3, 4 having max(score) >= {licenses.COSINE}),
        bk as (select doc_id, kind, sum(n_terms) as terms from b group by 1, 2), nt as (select doc_id, max(terms) as notice from bk group by 1),
        o as (select doc_id, arg_min(license, (-score, license)) as license, max(score) as score from b group by 1),
        own as (select f.doc_id, path, o.license, o.score, o.license is not null and (notice >= {licenses.SHARE} * len(regexp_split_to_array(trim(coalesce(text, '')), '\\s+')) or {named}) as speaks,
            regexp_replace(path, '/[^/]*$', '') as dir from f left join o on o.doc_id = f.doc_id left join nt on nt.doc_id = f.doc_id),
        sp as (select dir, arg_min(license, (-score, path, doc_id)) as license, max(score) as score from own where speaks group by 1),
        up as (select dir, 0 as n, dir as anc from (select distinct dir from own) union all select dir, n, array_to_string(string_split(dir, '/')[1:len(string_split(dir, '/')) - n], '/')
            from (select distinct dir, unnest(generate_series(1, len(string_split(dir, '/')))) as n from own)),
        near as (select up.dir, arg_min(sp.license, n) as license, arg_min(sp.score, n) as score, arg_min(anc, n) as anc from up join sp on sp.dir = anc group by 1)
        select own.doc_id, path, coalesce(own.license, near.license) as license, coalesce(own.score, near.score) as score,
        case when own.license is not null then 'declared' when near.license is not null then 'inherited' else 'none' end as origin, case when own.license is null then near.anc end as from_dir
        from own left join near on near.dir = own.dir and own.license is null"""


ORACLES: dict[str, str] = {
    "op4_license_scan": _license_sql(),
    "op2_near_dedup": f"""with recursive t as (select doc_id, {_WORDS.format(text=_ASCII_LOWER)} as w from documents),
        sh as ({_shingles("t", "doc_id", 4)}), n as (select doc_id, count(*) as n from sh group by 1),
        pair as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
        link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
        reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on l.a = r.b),
        least as (select a, least(a, min(b)) as m from reach group by 1)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m, d.doc_id) as component_id, d.doc_id = coalesce(m, d.doc_id) as kept
        from documents d left join n on n.doc_id = d.doc_id left join least on a = d.doc_id""",
    "op5_decontamination": f"""with i as (select item_id, {_WORDS.format(text="lower(text)")} as w from benchmark), t as (select doc_id, {_WORDS.format(text="lower(text)")} as w from documents),
        q as ({_shingles("i", "item_id", 5)}), d as ({_shingles("t", "doc_id", 5)}), n as (select item_id, count(*) as n from q group by 1),
        c as (select doc_id, item_id, count(*) as c from d join q on d.s = q.s group by 1, 2)
        select doc_id, c.item_id, n as n_shingles, c as n_shared, c / n as containment from c join n on n.item_id = c.item_id where c >= 0.8 * n""",
    "op6_mixing": f"""with r as (select doc_id, source, len({_WORDS.format(text="text")}) as size from documents),
        st as (select source, count(*) as n_docs, cast(sum(size) as bigint) as source_size from r group by 1),
        w as (select *, case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5e0 when 1 then 2e0 else 1e0 end as weight from st),
        x as (select *, 3 * source_size / weight as ratio, sum(source_size) over () as total from w),
        y as (select *, (total - coalesce(sum(3e0 * source_size) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0))
            / (sum(weight) over () - coalesce(sum(weight) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0)) as lvl,
            row_number() over (order by ratio, source is null, source) as pos from x),
        f as (select min(pos) as pos from y where ratio >= lvl), l as (select y.pos, lvl from y join f on f.pos = y.pos),
        tg as (select source, n_docs, source_size, round(least(3e0 * source_size, case when y.pos < l.pos then 3e0 * source_size else l.lvl * weight end), 6) as target from y cross join l),
        c as (select r.doc_id, r.source, r.size, tg.source_size, tg.target, case when tg.source_size > 0 then tg.target / tg.source_size else 0 end as rate,
            case when size > 0 then floor(log2(size + 0.5e0) * 4) else -1 end as cls, (coalesce(doc_id, 0) % 1000003) * 7919 % greatest(1, cast(ceil(sqrt(n_docs)) as bigint)) as bucket
            from r join tg on tg.source is not distinct from r.source),
        k as (select *, row_number() over (partition by source order by cls, bucket, size, doc_id) as i,
            cast('0x' || substr(md5('mix-1:' || coalesce(source, chr(0) || 'null')), 1, 8) as ubigint) / 4294967296e0 as u from c)
        select doc_id, size, source_size, target, cast(case when size > 0 then least(3, floor(rate * i + u) - floor(rate * (i - 1) + u)) * size else 0 end as bigint) as taken from k""",
}
