"""Duplicate samples: fingerprints, bucket pairs, similarity, which id is right, merging, and the best row of an id."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from ..plans.engine import PYTHON, register

_TRIO = "case when gc < (case when gs = 2 then 1 else 0 end) + (case when gd = 2 then 1 else 0 end) or gc > (case when gs >= 1 then 1 else 0 end) + (case when gd >= 1 then 1 else 0 end) then 1 else 0 end"
#: Errors of cells (gc, gs, gd) with sire_row and dam_row: against both parents if both are genotyped, else against the one that is.
_ERRORS = f"count(*) as n_valid, cast(sum(case when sire_row is not null and dam_row is not null then {_TRIO} else case when abs(gc - coalesce(gs, gd)) = 2 then 1 else 0 end end) as bigint) as n_errors"
_CALLED = "gc is not null and (sire_row is null or gs is not null) and (dam_row is null or gd is not null)"

register(
    {
        # the first markers of the panel as a string (missing 3), and a coarse share of calls; rows that are equal in both share a bucket
        "id_panel_order": "select snp_idx, row_number() over (order by chr, bin) as k, count(*) over () as n from id_panel",
        "id_cells": "select g.animal_id, o.k, g.g, cast(least(o.n, least($fp_max, greatest($fp_min, floor(o.n / 150)))) as bigint) as n_fp from geno g join id_panel_order o on g.snp_idx = o.snp_idx",
        "row_fingerprints": {
            "spark": """select animal_id, concat_ws('', transform(array_sort(collect_list(case when k <= n_fp then struct(k, cast(coalesce(g, 3) as string) as c) end)), x -> x.c)) as fp,
                least(255, cast(floor(count(g) / max(n_fp)) as bigint)) as call_bin, count(g) as called from id_cells group by animal_id""",
            "duckdb": """select animal_id, string_agg(case when k <= n_fp then cast(coalesce(g, 3) as varchar) end, '' order by k) as fp, least(255, cast(floor(count(g) / max(n_fp)) as bigint)) as call_bin,
                count(g) as called from id_cells group by animal_id""",
        },
        "id_fingerprint": "select animal_id, fp, call_bin from row_fingerprints",
        "bucket_pairs": "select a.animal_id as row_a, b.animal_id as row_b, a.called as called_a, b.called as called_b from row_fingerprints a join row_fingerprints b on a.fp = b.fp and a.call_bin = b.call_bin and a.animal_id < b.animal_id",
        "id_bucket_pairs": "select row_a, row_b from bucket_pairs",
        "pair_cells": """select p.row_a, p.row_b, a.snp_idx, a.g as ga, b.g as gb, o.k, m.autosome from bucket_pairs p join geno a on p.row_a = a.animal_id join geno b on p.row_b = b.animal_id and a.snp_idx = b.snp_idx
            left join id_panel_order o on a.snp_idx = o.snp_idx left join autosome_mask m on a.snp_idx = m.snp_idx""",
        "pair_counts": """select row_a, row_b, count(case when k is not null and ga is not null and gb is not null then 1 end) as comparable, count(case when k is not null and ga = gb then 1 end) as same,
            count(case when autosome = 1 and ga is not null and gb is not null then 1 end) as all_comparable, count(case when autosome = 1 and ga = gb then 1 end) as all_same from pair_cells group by row_a, row_b""",
        "pair_similarity": "select row_a, row_b, comparable, same, round(same * 1.0e0 / greatest(1, comparable), 6) as rate from pair_counts",
        "pair_similarity_confirm": "select row_a, row_b, all_comparable as comparable, all_same as same from pair_counts",
        # enough equal genotypes on the panel, and where enough markers compare also over all autosomes
        "alike_pairs": """select * from pair_counts where comparable >= $merge_min and same * 1.0e0 / comparable >= $merge_rate and (all_comparable < $confirm_min or all_same * 1.0e0 / all_comparable >= $confirm_rate)""",
        # the shared genotype (the first row's) against the recorded parents of each id
        "pair_sides": "select row_a, row_b, row_a as side from bucket_pairs union all select row_a, row_b, row_b from bucket_pairs",
        "side_cells": """select x.row_a, x.row_b, x.side, r.sire_row, r.dam_row, c.g as gc, s.g as gs, d.g as gd from pair_sides x join relations_of r on x.side = r.animal_id and r.kind <> 'none'
            join geno c on x.row_a = c.animal_id join id_panel_order o on c.snp_idx = o.snp_idx left join geno s on r.sire_row = s.animal_id and c.snp_idx = s.snp_idx left join geno d on r.dam_row = d.animal_id and c.snp_idx = d.snp_idx""",
        "side_scores": f"select row_a, row_b, side, case when n_valid >= $eval_min then 1 - n_errors * 1.0e0 / n_valid else -1e0 end as score from (select row_a, row_b, side, {_ERRORS} from side_cells where {_CALLED} group by row_a, row_b, side) e",
        "resolved_pairs": """select p.*, case when coalesce(b.score, -1e0) > coalesce(a.score, -1e0) + 0.005e0 then p.row_b when coalesce(a.score, -1e0) > coalesce(b.score, -1e0) + 0.005e0 then p.row_a end as keep_row
            from bucket_pairs p left join side_scores a on p.row_a = a.row_a and p.row_b = a.row_b and a.side = p.row_a left join side_scores b on p.row_a = b.row_a and p.row_b = b.row_b and b.side = p.row_b""",
        "resolve_pair": "select row_a, row_b, keep_row from resolved_pairs",
        # pairs in their order: a row that was dropped takes part no more, a pair that can't be resolved waits
        "merge_queue": """select f.fp, p.row_a, p.row_b, r.keep_row, r.called_a, r.called_b, p.comparable, p.same, row_number() over (order by p.row_a, p.row_b) as k from alike_pairs p
            join resolved_pairs r on p.row_a = r.row_a and p.row_b = r.row_b join row_fingerprints f on p.row_a = f.animal_id""",
        "merge_walk": {
            "duckdb": """/*recursive*/ select cast(0 as bigint) as k, cast([] as bigint[]) as gone, cast(null as bigint) as row_a, cast(null as bigint) as row_b, cast(null as bigint) as keep_row, cast(null as varchar) as state
                union all select q.k, case when list_contains(w.gone, q.row_a) or list_contains(w.gone, q.row_b) or q.keep_row is null then w.gone else list_append(w.gone, q.row_a + q.row_b - q.keep_row) end, q.row_a, q.row_b, q.keep_row,
                case when list_contains(w.gone, q.row_a) or list_contains(w.gone, q.row_b) then 'GONE' when q.keep_row is null then 'DEFERRED' else 'MERGED' end from merge_walk w join merge_queue q on q.k = w.k + 1""",
            "spark": "select row_a, row_b, keep_row, state from merge_states",
        },
        "merges": "select q.*, w.state from merge_queue q join merge_walk w on q.row_a = w.row_a and q.row_b = w.row_b",
        "merge_identical": "select keep_row, row_a + row_b - keep_row as drop_row, comparable, round(same * 1.0e0 / comparable, 6) as rate from merges where state = 'MERGED'",
        # what one row misses the other fills; a conflict becomes missing
        "merge_rows": """select c.row_a, c.row_b, c.snp_idx, case when ga is null then gb when gb is null then ga when ga = gb then ga end as g, case when ga <> gb then 1 else 0 end as conflict
            from pair_cells c join merges m on c.row_a = m.row_a and c.row_b = m.row_b and m.state = 'MERGED'""",
        # what waits at the end: the row with more calls on the panel
        "finalize_deferred": """select m.row_a, m.row_b, case when m.called_b > m.called_a then m.row_b else m.row_a end as keep_row from merges m left join merge_identical x on m.row_a = x.drop_row
            left join merge_identical y on m.row_b = y.drop_row where m.state = 'DEFERRED' and x.drop_row is null and y.drop_row is null""",
        "rewrite_parent_refs": """select p.animal_id, coalesce(s.keep_row, p.sire_id) as sire_id, coalesce(d.keep_row, p.dam_id) as dam_id
            from ped p left join merge_identical s on p.sire_id = s.drop_row left join merge_identical d on p.dam_id = d.drop_row""",
        "dropped_anti": "select g.animal_id from genotyped g left join merge_identical m on g.animal_id = m.drop_row where m.drop_row is null",
        # several rows of one id: equal to the first over all autosomes, or fitting the recorded parents best, or with most calls
        "dup_id_groups": "select id, count(*) as n from labelled_rows group by id having count(*) > 1",
        "id_first": "select l.id, min(l.row_id) as first_row from labelled_rows l join dup_id_groups d on l.id = d.id group by l.id",
        "first_row_parent": """select p.animal_id, s.first_row as sire_row, d.first_row as dam_row from ped p left join (select id, min(row_id) as first_row from labelled_rows group by id) s on p.sire_id = s.id
            left join (select id, min(row_id) as first_row from labelled_rows group by id) d on p.dam_id = d.id""",
        "id_rows": """select l.id, l.row_id, f.first_row, x.sire_row, x.dam_row from labelled_rows l join id_first f on l.id = f.id left join first_row_parent x on l.id = x.animal_id""",
        "id_row_cells": """select r.id, r.row_id, r.sire_row, r.dam_row, c.g as gc, f.g as gf, s.g as gs, d.g as gd, m.autosome from id_rows r join geno c on r.row_id = c.animal_id
            join geno f on r.first_row = f.animal_id and c.snp_idx = f.snp_idx left join geno s on r.sire_row = s.animal_id and c.snp_idx = s.snp_idx left join geno d on r.dam_row = d.animal_id and c.snp_idx = d.snp_idx
            left join autosome_mask m on c.snp_idx = m.snp_idx""",
        "id_row_counts": """select id, row_id, max(case when sire_row is not null or dam_row is not null then 1 else 0 end) as has_parents, count(gc) as called, count(case when autosome = 1 and gc is not null and gf is not null then 1 end) as comparable,
            count(case when autosome = 1 and gc = gf then 1 end) as same from id_row_cells group by id, row_id""",
        "id_row_errors": f"select id, row_id, {_ERRORS} from id_row_cells where autosome = 1 and {_CALLED} and (sire_row is not null or dam_row is not null) group by id, row_id",
        "id_row_scores": """select c.*, case when e.n_valid >= $eval_min then 1 - e.n_errors * 1.0e0 / e.n_valid else -1e0 end as score,
            min(case when c.comparable >= $eval_min and c.same * 1.0e0 / c.comparable >= 0.995e0 then 1 else 0 end) over (partition by c.id) as identical
            from id_row_counts c left join id_row_errors e on c.id = e.id and c.row_id = e.row_id""",
        "id_row_ranks": """select *, row_number() over (partition by id order by case when identical = 1 then 0e0 when has_parents = 1 then -score else -called * 1.0e0 end, row_id) as k from id_row_scores""",
        "resolve_same_id": """select id, row_id, case when identical = 1 then 'MERGED' when has_parents = 1 then 'PARENTS' else 'CALLS' end as by_rule,
            case when k > 1 then 2 when identical = 0 and has_parents = 0 then 1 else 0 end as action from id_row_ranks""",
        "best_duplicate_row": "select id, row_id, action from resolve_same_id where action < 2",
    },
    {"fp_min": 16, "fp_max": 512, "merge_min": 500, "merge_rate": "0.95e0", "confirm_min": 2000, "confirm_rate": "0.995e0", "eval_min": 100},
    {"fp_min": 6, "merge_min": 5, "merge_rate": "0.50e0", "eval_min": 10},
    steps=("id_panel_order", "row_fingerprints", "bucket_pairs", "pair_counts", "side_scores", "merges", "id_row_scores"),
)


def _walk(parameters: dict, merge_queue: DataFrame) -> DataFrame:
    """Pairs share no row beyond their fingerprint, so each fingerprint's pairs are walked alone."""

    def walk(held: pd.DataFrame) -> pd.DataFrame:
        gone: set[int] = set()
        states = []
        held = held.sort_values(["row_a", "row_b"])
        for a, b, keep in zip(held["row_a"], held["row_b"], held["keep_row"], strict=True):
            if a in gone or b in gone:
                states.append("GONE")
            elif pd.isna(keep):
                states.append("DEFERRED")
            else:
                states.append("MERGED")
                gone.add(int(a + b - keep))
        return held[["row_a", "row_b", "keep_row"]].assign(state=states)

    return merge_queue.groupBy("fp").applyInPandas(walk, "row_a long, row_b long, keep_row long, state string")


PYTHON["merge_states"] = (("merge_queue",), _walk)

QUERIES = [
    "id_fingerprint", "id_bucket_pairs", "pair_similarity", "pair_similarity_confirm", "merge_identical", "merge_rows", "dup_id_groups", "resolve_same_id", "best_duplicate_row", "resolve_pair",
    "finalize_deferred", "rewrite_parent_refs", "dropped_anti", "first_row_parent",
]
