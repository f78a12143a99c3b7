"""Imputation: quality filters, Mendelian fill, haplotype windows with votes, and neighbour counts."""

from __future__ import annotations

from ..plans.engine import register

_FILL = "case when f.gc is null and f.gs in (0, 2) and f.gd in (0, 2) then (f.gs + f.gd) / 2 end"



def _window_cells(name: str, source: str, layers: tuple[int, ...]) -> dict[str, str]:
    """Cells with the windows that hold them; a cell's window number is arithmetic, so this is an equi-join."""
    at = {0: "floor((f.snp_idx - 1) / $width)", 1: "floor((f.snp_idx - 1 - $shift) / $width)"}
    one = "select f.animal_id, f.snp_idx, f.g, w.window_id, w.first_snp, w.last_snp, w.layer from {source} f join hap_windows w on w.layer = {layer} and w.w = cast({at} as bigint)"
    return {name: " union all ".join(one.format(source=source, layer=k, at=at[k]) for k in layers)}


def _keys(name: str, cells: str) -> dict[str, str]:
    return {name: f"""select window_id, layer, first_snp, last_snp - first_snp + 1 as len, animal_id, sum(coalesce(g, 0) * power(3e0, snp_idx - first_snp)) as hap, count(*) - count(g) as missing
        from {cells} group by window_id, layer, first_snp, last_snp, animal_id"""}


def _pass(name: str, keys: str, cells: str, layer: int) -> dict[str, str]:
    """Matches, votes and fills of one layer: a candidate and the representative need most of a window called; a vote weighs what a
    reference has called of the window, and ties go to the smaller genotype."""
    enough = "greatest($called_floor, floor(7 * k.len / 10))"
    return {
        f"{name}_matches": f"""select k.window_id, k.first_snp, k.len, k.animal_id, k.hap from {keys} k join hap_refs r on k.window_id = r.window_id and k.hap = r.hap and r.k = 1
            where k.layer = {layer} and k.len - k.missing >= {enough} and r.len - r.missing >= {enough}""",
        f"{name}_votes": f"""select c.animal_id, c.snp_idx, v.g, sum(greatest(1, r.len - r.missing)) as weight from {name}_matches m join {cells} c on m.window_id = c.window_id and m.animal_id = c.animal_id
            join hap_refs r on m.window_id = r.window_id and m.hap = r.hap and r.k <= 5 join filled v on r.animal_id = v.animal_id and v.snp_idx = c.snp_idx
            where c.g is null and v.g is not null group by c.animal_id, c.snp_idx, v.g""",
        f"{name}_fills": f"select animal_id, snp_idx, g from (select *, row_number() over (partition by animal_id, snp_idx order by weight desc, g) as k from {name}_votes) r where k = 1",
    }


def _walked(name: str, source: str, own: str, beside: str) -> dict[str, dict[str, str]]:
    """A fill marker by marker as a recursion over markers, for DuckDB: each row carries its last calls; Spark does it in custom.py."""
    return {name: {
        "spark": "select * from none",
        "duckdb": f"""select animal_id, snp_idx, g from (with recursive own as (select snp_idx, g, n from {own}), near as (select snp_idx, distance, neighbour, g, n from {beside}),
            cells as (select animal_id, snp_idx, g, max(snp_idx) over () as last_snp from {source}),
            walk as (select animal_id, 0 as snp_idx, cast(null as int) as g, 0 as fresh, cast([] as int[]) as before from (select distinct animal_id from cells) a
              union all select w.animal_id, w.snp_idx + 1, x.g, x.fresh, list_append(w.before, x.g) from walk w join lateral (
                select coalesce(c.g, (select o.g from own o where o.snp_idx = c.snp_idx order by o.n
                  + coalesce((select sum(e.n) from near e where e.snp_idx = c.snp_idx and e.g = o.g and e.distance < 0 and e.neighbour = w.before[c.snp_idx + e.distance] and c.snp_idx + e.distance >= 1), 0)
                  + coalesce((select sum(e.n) from near e join cells b on b.animal_id = c.animal_id and b.snp_idx = c.snp_idx + e.distance and b.g = e.neighbour where e.snp_idx = c.snp_idx and e.g = o.g and e.distance > 0), 0) desc, o.g limit 1)) as g,
                  case when c.g is null then 1 else 0 end as fresh from cells c where c.animal_id = w.animal_id and c.snp_idx = w.snp_idx + 1) x on true)
            select animal_id, snp_idx, g from walk where fresh = 1 and g is not null) t""",
    }}


register(
    {
        "sample_missing_filter": "select animal_id, n_snps - n_valid as n_missing from animal_rates where 1 - cr <= $max_sample_missing",
        "snp_missing_maf_filter": "select snp_idx, round(1 - cr, 6) as missing, round(least(fa, fb), 6) as maf from snp_freqs where 1 - cr <= $max_snp_missing and least(fa, fb) >= $min_snp_maf",
        "ambiguous_snp_filter": "select snp_id, a1, a2 from alleles where concat(least(a1, a2), greatest(a1, a2)) not in ('AT', 'CG')",
        "pool_cand_ref": """select snp_idx, panel_part, count(g) as n_valid, count(*) as n from (select g.snp_idx, g.g, 'all' as panel_part from geno g
            union all select g.snp_idx, g.g, case when p.sex = 2 then 'reference' else 'candidate' end from geno g join ped p on g.animal_id = p.animal_id) u group by snp_idx, panel_part""",
        "removed_set": "select animal_id from genotyped except select animal_id from sample_missing_filter",
        "ref_panel_filter": "select animal_id, round(1 - cr, 6) as missing from animal_rates where 1 - cr <= 0.10e0",
        "impute_qc": "select g.snp_idx, count(*) as cells, count(g.g) as called from geno g join sample_missing_filter a on g.animal_id = a.animal_id join snp_missing_maf_filter s on g.snp_idx = s.snp_idx group by g.snp_idx",
        "trio_index": "select animal_id, sire_row, dam_row from relations_of where kind = 'trio'",
        "duo_trio_index": "select animal_id, sire_row, dam_row, kind from relations_of where kind <> 'none'",
        "mendel_fills": f"select animal_id, snp_idx, cast({_FILL} as int) as g from family_cells f where {_FILL} is not null",
        "mendel_fill": "select animal_id, snp_idx, g from mendel_fills",
        "family_phase": """select m.chr, count(case when f.gc is null and f.gs is not null and f.gd is not null then 1 end) as checked, count(x.g) as filled
            from family_cells f join snp_map m on f.snp_idx = m.snp_idx left join mendel_fills x on f.animal_id = x.animal_id and f.snp_idx = x.snp_idx group by m.chr""",
        "phasing_cells": "select f.snp_idx, f.animal_id, x.g from family_cells f left join mendel_fills x on f.animal_id = x.animal_id and f.snp_idx = x.snp_idx where f.gc is null and f.gs is not null and f.gd is not null",
        "phasing_counts": "select snp_idx, count(*) as checked, count(g) as filled from phasing_cells group by snp_idx",
        "phasing_stats": """select p.snp_idx, m.chr, p.checked, p.filled, case when row_number() over (order by p.filled desc, p.snp_idx) <= 5 then 1 else 0 end as top5
            from phasing_counts p join (select snp_idx, min(chr) as chr from snp_map group by snp_idx) m on p.snp_idx = m.snp_idx""",
        "filled": "select g.animal_id, g.snp_idx, coalesce(g.g, m.g) as g from geno g left join mendel_fills m on g.animal_id = m.animal_id and g.snp_idx = m.snp_idx",
        # base windows of a width, the last may be shorter, and after them the same shifted where they still fit; missing counts as 0 in a key
        "hap_base": "select w, w * $width + 1 as first_snp, least(w * $width + $width, n) as last_snp, n from (select distinct cast(floor((snp_idx - 1) / $width) as bigint) as w from snp_map) b cross join (select max(snp_idx) as n from snp_map) m",
        "hap_windows": """select w as window_id, w, first_snp, last_snp, 0 as layer from hap_base
            union all select w + (select count(*) from hap_base), w, first_snp + $shift, last_snp + $shift, 1 from hap_base where $shift > 0 and last_snp + $shift <= n""",
        **_window_cells("window_cells", "filled", (0, 1)),
        **_keys("hap_keys", "window_cells"),
        "hap_key": "select window_id, animal_id, cast(hap as bigint) as hap, missing from hap_keys",
        "count_missing": "select window_id, cast(sum(missing) as bigint) as missing, count(*) as n_rows from hap_keys group by window_id",
        "hap_refs": "select window_id, hap, animal_id, len, missing, row_number() over (partition by window_id, hap order by missing, animal_id) as k, count(*) over (partition by window_id, hap) as n from hap_keys",
        "hap_panel": "select window_id, cast(hap as bigint) as hap, n, animal_id as rep_row, missing from hap_refs where k = 1",
        "topk_refs": "select window_id, cast(hap as bigint) as hap, animal_id, missing, k from hap_refs where k <= 5",
        "top5_windows": "select window_id, count(*) as n_keys from hap_panel group by window_id order by n_keys desc, window_id limit 5",
        "hap_key_probe": "select k.window_id, k.animal_id, p.rep_row, p.n from hap_key k join hap_panel p on k.window_id = p.window_id and k.hap = p.hap",
        # base windows first; what they fill changes the keys of the shifted ones. The panel stays as it was
        **_pass("base", "hap_keys", "window_cells", 0),
        "filled_once": "select f.animal_id, f.snp_idx, coalesce(f.g, x.g) as g from filled f left join base_fills x on f.animal_id = x.animal_id and f.snp_idx = x.snp_idx",
        **_window_cells("shifted_cells", "filled_once", (1,)),
        **_keys("shifted_keys", "shifted_cells"),
        **_pass("shifted", "shifted_keys", "shifted_cells", 1),
        "hap_match": "select window_id, animal_id, cast(hap as bigint) as hap from base_matches union all select window_id, animal_id, cast(hap as bigint) from shifted_matches",
        "hap_fills": "select animal_id, snp_idx, g from base_fills union all select animal_id, snp_idx, g from shifted_fills",
        "hap_vote": "select animal_id, snp_idx, g from hap_fills",
        # missing cells that a matched window looked at, and those that it filled
        "hap_effect": """select (select count(*) from base_matches m join window_cells c on m.window_id = c.window_id and m.animal_id = c.animal_id where c.g is null)
            + (select count(*) from shifted_matches m join shifted_cells c on m.window_id = c.window_id and m.animal_id = c.animal_id where c.g is null) as checked, (select count(*) from hap_fills) as filled""",
        "fill_rates": "select (select count(*) from geno where g is null) as missing, (select count(*) from mendel_fills) as by_mendel, (select count(*) from hap_fills) as by_window",
        # genotypes beside each genotype, by distance and side
        "ld_offsets": {"spark": "select d from (select explode(sequence(-$ld_window, $ld_window)) as d) x where d <> 0", "duckdb": "select cast(d as int) as d from (select unnest(range(-$ld_window, $ld_window + 1)) as d) x where d <> 0"},
        "ld_cells": "select a.animal_id, a.snp_idx, a.g, o.d, a.snp_idx + o.d as beside from geno a cross join ld_offsets o",
        "ld_beside": "select a.animal_id, a.snp_idx, a.g, a.d, b.g as neighbour from ld_cells a join geno b on a.animal_id = b.animal_id and a.beside = b.snp_idx where b.g is not null",
        "ld_counts": "select snp_idx, d as distance, neighbour, g, count(*) as n from ld_beside where g is not null group by snp_idx, d, neighbour, g",
        "ld_neighbours": "select animal_id, snp_idx, count(*) as n_called from ld_beside where g is null group by animal_id, snp_idx",
        # every missing cell takes the genotype that is most frequent, counted with its neighbours' (as they were called)
        "ld_scores": """select c.animal_id, c.snp_idx, l.g, sum(l.n) as score from ld_beside c join ld_counts l on c.snp_idx = l.snp_idx and l.distance = c.d and l.neighbour = c.neighbour
            where c.g is null group by c.animal_id, c.snp_idx, l.g""",
        "snp_g": "select snp_idx, g, count(*) as n from geno where g is not null group by snp_idx, g",
        "ld_fill_parallel": """select animal_id, snp_idx, g from (select c.animal_id, c.snp_idx, f.g, row_number() over (partition by c.animal_id, c.snp_idx order by f.n + coalesce(s.score, 0) desc, f.g) as k
            from (select animal_id, snp_idx from geno where g is null) c join snp_g f on c.snp_idx = f.snp_idx left join ld_scores s on c.animal_id = s.animal_id and c.snp_idx = s.snp_idx and f.g = s.g) r where k = 1""",
        # with the reference animals and without them the complete trios are the same: both fill rates are reported
        "ref_compare": """select panel, count(*) as checked, cast(sum(case when g is not null then 1 else 0 end) as bigint) as filled from (
            select 'with' as panel, x.g from family_missing f left join mendel_fills x on f.animal_id = x.animal_id and f.snp_idx = x.snp_idx
            union all select 'without', x.g from family_missing f left join mendel_fills x on f.animal_id = x.animal_id and f.snp_idx = x.snp_idx) u group by panel""",
        "family_missing": "select animal_id, snp_idx from family_cells where gc is null and gs is not null and gd is not null",
        # what every step leaves, in order: trios, windows, neighbours
        "imputed": {
            "spark": """select g.animal_id, g.snp_idx, coalesce(g.g, m.g, h.g, l.g) as g, case when g.g is not null then 'called' when m.g is not null then 'family' when h.g is not null then 'window' when l.g is not null then 'neighbours' else 'missing' end as filled_by
            from geno g left join mendel_fills m on g.animal_id = m.animal_id and g.snp_idx = m.snp_idx left join hap_fills h on g.animal_id = h.animal_id and g.snp_idx = h.snp_idx
            left join ld_fills l on g.animal_id = l.animal_id and g.snp_idx = l.snp_idx""",
            "duckdb": """select g.animal_id, g.snp_idx, coalesce(g.g, m.g, h.g, l.g) as g, case when g.g is not null then 'called' when m.g is not null then 'family' when h.g is not null then 'window' when l.g is not null then 'neighbours' else 'missing' end as filled_by
            from geno g left join mendel_fills m on g.animal_id = m.animal_id and g.snp_idx = m.snp_idx left join hap_fills h on g.animal_id = h.animal_id and g.snp_idx = h.snp_idx
            left join ld_walked l on g.animal_id = l.animal_id and g.snp_idx = l.snp_idx""",
        },
        "windowed": "select f.animal_id, f.snp_idx, coalesce(f.g, h.g) as g from filled f left join hap_fills h on f.animal_id = h.animal_id and f.snp_idx = h.snp_idx",
        "impute_pipeline": "select animal_id, snp_idx, g, filled_by from imputed",
        # the same fill as ld_fills, one marker after the other: a filled cell is a neighbour of those after it
        "w_snp_g": "select snp_idx, g, count(*) as n from windowed where g is not null group by snp_idx, g",
        "w_counts": "select a.snp_idx, b.snp_idx - a.snp_idx as distance, b.g as neighbour, a.g, count(*) as n from windowed a join windowed b on a.animal_id = b.animal_id and b.snp_idx <> a.snp_idx and abs(b.snp_idx - a.snp_idx) <= $ld_window where a.g is not null and b.g is not null group by all",
        **_walked("ld_walked", "windowed", "w_snp_g", "w_counts"),
        **_walked("ld_fill_walked", "geno", "snp_g", "ld_counts"),
        "ld_fill": {"spark": "select animal_id, snp_idx, g from ld_filled", "duckdb": "select animal_id, snp_idx, g from ld_fill_walked"},
    },
    {"max_sample_missing": "0.10e0", "max_snp_missing": "0.02e0", "min_snp_maf": "0.01e0", "width": 24, "shift": 8, "called_floor": 10, "ld_window": 2},
    {"max_sample_missing": "0.05e0", "min_snp_maf": "0.12e0", "width": 6, "shift": 3, "called_floor": 4, "ld_window": 3},
    steps=("filled", "mendel_fills", "hap_keys", "hap_refs", "base_fills", "shifted_keys", "shifted_fills", "hap_windows", "window_cells", "filled_once", "shifted_cells", "hap_base", "windowed"),
)

QUERIES = [
    "sample_missing_filter", "snp_missing_maf_filter", "ambiguous_snp_filter", "pool_cand_ref", "removed_set", "ref_panel_filter", "impute_qc", "trio_index", "duo_trio_index", "mendel_fill", "family_phase", "phasing_stats",
    "hap_windows", "hap_key", "count_missing", "hap_panel", "topk_refs", "top5_windows", "hap_key_probe", "hap_match", "hap_vote", "fill_rates", "ld_counts", "ld_neighbours", "ld_fill_parallel", "ld_fill", "ref_compare", "impute_pipeline",
]
