"""Genotype-shaped views over the driver's tables, one SQL text for both engines.

`embeddings` become dosages with banded correlations in blocks of 16 variants; a phenotype, marginal statistics, a
panel and perturbed rows follow from them. `part` and `lineitem` give a larger panel with several statistics a variant; in `sumstats_pairs` two neighbouring suppliers share an id.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

CELL = {
    "spark": "select vec_id s, cast(pos as bigint) v, cast(e as double) e from embeddings lateral view posexplode(embedding) t as pos, e",
    "duckdb": "select vec_id s, cast(i - 1 as bigint) v, cast(embedding[i] as double) e from (select vec_id, embedding, unnest(generate_series(1, 64)) i from embeddings)",
}
ALLELES = "case when {v} % 16 = 15 then '{x}' when {v} % 4 = 0 then '{a}' when {v} % 4 = 1 then '{b}' when {v} % 4 = 2 then '{c}' else '{d}' end"


def a1(v: str) -> str:
    return ALLELES.format(v=v, x="A", a="A", b="C", c="A", d="G")


def a2(v: str) -> str:
    return ALLELES.format(v=v, x="T", a="G", b="T", c="C", d="T")


def comp(x: str) -> str:
    return f"case {x} when 'A' then 'T' when 'T' then 'A' when 'C' then 'G' when 'G' then 'C' end"


VIEWS = {
    "b": """select a.s, a.v, a.e + 0.8 * coalesce(l1.e, 0.0) + 0.6 * coalesce(l2.e, 0.0) x from cell a
        left join cell l1 on l1.s = a.s and l1.v = a.v - 1 and l1.v DIV 16 = a.v DIV 16
        left join cell l2 on l2.s = a.s and l2.v = a.v - 2 and l2.v DIV 16 = a.v DIV 16""",
    "geno": "select s, v, case when (s * 64 + v) % 53 = 0 then null when x < -0.07 then 0 when x < 0.07 then 1 else 2 end g from b",
    "variants": f"select v vidx, concat('rs', v) id, cast(v DIV 32 + 1 as string) chrom, 1000 * (v + 1) pos, {a1('v')} a1, {a2('v')} a2 from (select distinct v from cell) t",
    "pheno": "select g.s, sum(case when g.v % 13 = 0 then 0.3 * (coalesce(g.g, 1) - 1) else 0.0 end) + (max(e.label) - 4.5) / 10.0 y from geno g join embeddings e on e.vec_id = g.s group by g.s",
    "sums": "select g.v, count(g.g) n, sum(cast(g.g as double)) sx, sum(p.y) sy, sum(cast(g.g * g.g as double)) sxx, sum(g.g * p.y) sxy, sum(p.y * p.y) syy from geno g join pheno p on p.s = g.s where g.g is not null group by g.v",
    "marginal": """select v, n, sx / n / 2 af, (n * sxy - sx * sy) / (n * sxx - sx * sx) beta, sxx - sx * sx / n vx, syy - sy * sy / n vy from sums""",
    "effects": "select v vidx, round(beta, 6) beta, round(sqrt(greatest(vy - beta * beta * vx, 0.0) / (n - 2) / vx), 6) se, cast(n as double) n, round(af, 6) af from marginal",
    "sumstats": f"""select row_no, id, chrom, pos, ea, oa, beta, se, n_eff, eaf, info from (
        select e.vidx * 10 + d.d row_no, case when e.vidx % 11 = 3 then '' else concat('rs', e.vidx) end id,
        case when (e.vidx DIV 32) % 2 = 0 then concat('chr', e.vidx DIV 32 + 1) else cast(e.vidx DIV 32 + 1 as string) end chrom, 1000 * (e.vidx + 1) pos,
        case e.vidx % 7 when 1 then {a2('e.vidx')} when 2 then {comp(a1('e.vidx'))} else {a1('e.vidx')} end ea,
        case e.vidx % 7 when 1 then {a1('e.vidx')} when 2 then {comp(a2('e.vidx'))} else {a2('e.vidx')} end oa,
        case when e.vidx % 7 = 1 then -e.beta else e.beta end + 0.01 * d.d beta, case when e.vidx % 31 = 8 then null else e.se end se,
        case when e.vidx % 23 = 6 then e.n * 0.5 else e.n end n_eff, case when e.vidx % 29 = 7 then 0.005 else e.af end eaf, case when e.vidx % 19 = 5 then 0.5 else 0.95 end info
        from effects e join (select 0 d union all select 1 d) d on d.d = 0 or e.vidx % 17 = 4) t""",
    "weights": "select e.vidx, case when e.n * e.se * e.se + e.beta * e.beta > 0 then e.beta / sqrt(e.n * e.se * e.se + e.beta * e.beta) else 0.0 end weight from effects e",
    "variants_big": f"select p_partkey vidx, concat('rs', p_partkey) id, cast(p_partkey % 22 + 1 as string) chrom, p_partkey * 100 pos, {a1('p_partkey')} a1, {a2('p_partkey')} a2 from part",
    "sumstats_big": f"""select l_partkey * 1000000 + l_suppkey row_no, case when l_partkey % 10 = 0 then '' else concat('rs', l_partkey) end id, concat('chr', l_partkey % 22 + 1) chrom, l_partkey * 100 pos,
        case (l_partkey + l_suppkey) % 5 when 0 then {a1('l_partkey')} when 1 then {a2('l_partkey')} when 2 then {comp(a1('l_partkey'))} when 3 then {comp(a2('l_partkey'))} else 'A' end ea,
        case (l_partkey + l_suppkey) % 5 when 0 then {a2('l_partkey')} when 1 then {a1('l_partkey')} when 2 then {comp(a2('l_partkey'))} when 3 then {comp(a1('l_partkey'))} else 'A' end oa,
        round(avg(l_discount) - 0.05, 6) beta, case when l_suppkey % 41 = 3 then null else round(0.01 + avg(l_tax), 6) end se, cast(sum(l_quantity) * 1000 as double) n_eff,
        ((l_partkey * 7 + l_suppkey * 13) % 1000) / 1000.0 eaf, 0.5 + (l_suppkey % 6) / 10.0 info from lineitem group by l_partkey, l_suppkey""",
    "sumstats_pairs": "select row_no, case when id = '' then id else concat(id, '_', cast(row_no % 1000000 DIV 2 as string)) end id, chrom, pos, ea, oa, beta, se, n_eff, eaf, info from sumstats_big",
    "regions": "select * from (select '1' chrom, cast(5000 as bigint) start_pos, cast(12000 as bigint) end_pos union all select '2' chrom, cast(40000 as bigint) start_pos, cast(50000 as bigint) end_pos) t",
}
ORDER = ["cell", *VIEWS]


def text(name: str, engine: str) -> str:
    sql = CELL[engine] if name == "cell" else VIEWS[name]
    return sql.replace(" DIV ", " div " if engine == "spark" else " // ")


def needs(sql: str, given: Iterable[str] = ()) -> list[str]:
    """The views that a text uses, and theirs, in order; those given are not looked into."""
    import re

    found: set[str] = set()

    def look(s: str) -> None:
        for name in ORDER:
            if name not in found and name not in given and re.search(rf"\b(?:from|join)\s+{name}\b", s):
                found.add(name)
                look(text(name, "duckdb"))

    look(sql)
    return [x for x in ORDER if x in found]


def oracle(select: str, more: str = "") -> str:
    """A DuckDB query with the views that it uses in front. more: further views, `name as (...)`, comma-separated."""
    views = [f"{n} as ({text(n, 'duckdb')})" for n in needs(select + " " + more)]
    if more:
        views.append(more)
    start = "WITH RECURSIVE" if "union all" in more else "WITH"
    return (f"{start} {', '.join(views)} " if views else "") + select


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A view as a DataFrame. given: written tables that stand for views which it uses."""
    import re

    sql = f"WITH {', '.join(f'{n} as ({text(n, 'spark')})' for n in [*needs(f'from {name}', given)])} select * from {name}"
    for n, table in given.items():
        sql = re.sub(rf"\b(from|join) {n}\b", rf"\1 parquet.`{table._table_path}`", sql)
    return spark.sql(re.sub(r"\b(from|join) (embeddings|part|lineitem)\b", rf"\1 parquet.`{sf_dir}/\2.parquet`", sql))
