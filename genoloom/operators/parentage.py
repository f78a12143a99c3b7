"""Parentage search: identity swaps, candidates by age, opposite homozygotes and relationship, ranking per slot, and the outcome."""

from __future__ import annotations

from ..plans.engine import PYTHON, register
from .pairs import identity_pairs, panel_pairs

DEPTH = 3


def _chain() -> dict[str, str]:
    """The steps of a swap chain, one relation a depth: from an animal to its best mate, if that points back."""
    out = {}
    for k in range(1, DEPTH + 1):
        start = "select animal_id as child, animal_id as curr, byr, cast(null as bigint) as q1, cast(null as bigint) as q2 from seek_children"
        more = {1: "s.q as q1, s.q2", 2: "s.q1, s.q as q2", 3: "s.q1, s.q2"}.get(k - 1)
        before = start if k == 1 else f"select s.child, s.q as curr, s.byr, {more} from swap_step_{k - 1} s where s.whole = 0 and s.q <> s.child and (s.q1 is null or s.q <> s.q1)"
        out[f"swap_from_{k}"] = before
        # a mate whose recorded parents are old enough and of the right sex counts a hundredth more each
        out[f"swap_best_{k}"] = f"""select child, curr, byr, q1, q2, q, rate from (select c.*, m.b as q, m.n_same * 1.0e0 / m.n_valid as rate,
            row_number() over (partition by c.child order by m.n_same * 1.0e0 / m.n_valid + case when (c.byr - f.sire_byr < $min_age or c.byr - f.dam_byr < $min_age) then 0e0 else 0.01e0 end
              + case when f.sexes_fit = 1 then 0.01e0 else 0e0 end desc, m.b) as k
            from swap_from_{k} c join mates m on c.curr = m.a join mate_profiles f on m.b = f.animal_id) r where k = 1"""
        out[f"swap_step_{k}"] = f"""select c.*, f.whole from swap_best_{k} c join back_mates b on c.q = b.a and c.curr = b.b join mate_profiles f on c.q = f.animal_id"""
    union = " union all ".join(f"select child, q as mate, {k} as depth, rate from swap_step_{k} where whole = 1" for k in range(1, DEPTH + 1))
    return out | {"swaps": f"select child, mate, depth, rate from ({union}) u where depth <= $swap_depth"}


register(
    {
        # parents are sought after Mendelian errors or a sex conflict
        "seek_children": """select a.animal_id, p.byr, p.sire_id, p.dam_id, case when a.action = 1 and s.sex_qc = 1 then 'BTH' when a.action = 1 then 'MEN' else 'SEX' end as source
            from mendel_actions a join ped p on a.animal_id = p.animal_id join sex_checks s on a.animal_id = s.animal_id where a.action = 1 or s.sex_qc = 1""",
        # a candidate is another genotyped animal whose sex is confirmed; a year older at least where both birth years are known
        "candidates": "select g.animal_id as cand, p.byr, coalesce(p.sex, 0) as sex from genotyped g join sex_checks s on g.animal_id = s.animal_id left join ped p on g.animal_id = p.animal_id where s.sex_qc = 0",
        "birth_years": "select distinct byr from candidates",
        "age_years": "select c.animal_id as child, c.byr as child_byr, y.byr from seek_children c join birth_years y on c.byr is null or y.byr is null or y.byr <= c.byr - $min_age",
        "age_pairs": {
            "spark": "select c.child, p.cand, p.sex from age_years c join candidates p on c.byr <=> p.byr where p.cand <> c.child",
            "duckdb": "select c.animal_id as child, p.cand, p.sex from seek_children c join candidates p on p.cand <> c.animal_id where not coalesce(c.byr - p.byr < $min_age, false)",
        },
        "cand_age_sex": "select child, cand, sex from age_pairs",
        # the minor allele's frequency stands for that of the counted allele
        "panel_p": "select p.snp_idx, p.maf as p from panel p",
        "pair_scores": {
            "spark": """select c.animal_id as child, p.cand, p.sex, x.n_valid, x.n_errors, x.rel from child_scores x join seek_children c on x.a = c.animal_id join candidates p on x.b = p.cand
                where c.byr is null or p.byr is null or p.byr <= c.byr - $min_age""",
            "duckdb": """select a.child, a.cand, a.sex, count(*) as n_valid, cast(sum(case when abs(x.g - y.g) = 2 then 1 else 0 end) as bigint) as n_errors,
                sum((x.g - 2 * p.p) * (y.g - 2 * p.p)) / sum(2 * p.p * (1 - p.p)) as rel
                from age_pairs a join geno x on a.child = x.animal_id join geno y on a.cand = y.animal_id and x.snp_idx = y.snp_idx join panel_p p on x.snp_idx = p.snp_idx
                where x.g is not null and y.g is not null group by a.child, a.cand, a.sex""",
        },
        "compat_pairs": "select * from pair_scores where n_valid >= $compat_min and 1 - n_errors * 1.0e0 / n_valid >= $compat",
        "cand_compat": "select child, cand, n_valid, n_errors from compat_pairs",
        "kept_pairs": "select * from compat_pairs where abs(rel - 0.5e0) <= $g_tol",
        "cand_g": "select child, cand, round(rel, 6) as rel from kept_pairs",
        "candidate_parents": "select child, cand, sex, n_valid, n_errors, round(rel, 6) as rel from kept_pairs",
        # unknown sex competes for both
        "slots": """select k.child, k.cand, k.n_valid, k.n_errors, x.slot from kept_pairs k
                join (select 'sire' as slot, 1 as other union all select 'dam' as slot, 2 as other) x on k.sex <> x.other""",
        "cand_slot": "select child, cand, slot from slots",
        "slot_ranks": """select *, row_number() over (partition by child, slot order by n_errors, n_errors * 1.0e0 / n_valid, cand) as k, count(*) over (partition by child, slot) as n,
            row_number() over (partition by child, slot order by n_errors * 1.0e0 / n_valid, cand) as top from slots""",
        "best_candidate": "select child, slot, cand, n_errors, n_valid, n as n_candidates from slot_ranks where k = 1",
        # between the two highest compatibilities, whoever was chosen
        "top2_margin": """select child, slot, max(case when k = 1 then cand end) as best, round(max(case when top = 1 then 1 - n_errors * 1.0e0 / n_valid end), 6) as top_compat,
            round(case when max(n) > 1 then max(case when top = 1 then 1 - n_errors * 1.0e0 / n_valid end) - max(case when top = 2 then 1 - n_errors * 1.0e0 / n_valid end) else 0e0 end, 6) as margin
            from slot_ranks group by child, slot""",
        # mates: pairs of equal genotypes, whose second isn't to be deleted
        "deleted": "select animal_id from mendel_actions where action = 2",
        "mates": {
            "spark": "select a, b, n_valid, n_same from mate_counts",
            "duckdb": """select x.animal_id as a, y.animal_id as b, count(*) as n_valid, count(case when x.g = y.g then 1 end) as n_same
                from geno x join panel p on x.snp_idx = p.snp_idx join geno y on x.snp_idx = y.snp_idx and x.animal_id <> y.animal_id where x.g is not null and y.g is not null
                and y.animal_id not in (select animal_id from deleted) group by x.animal_id, y.animal_id having count(*) >= $compat_min and count(case when x.g = y.g then 1 end) * 1.0e0 / count(*) >= $swap_min""",
        },
        "back_mates": "select a, b from (select a, b, row_number() over (partition by a order by n_same * 1.0e0 / n_valid desc, b) as k from mates) r where k = 1",
        "mate_profiles": """select g.animal_id, case when p.sire_id is not null and p.dam_id is not null then 1 else 0 end as whole, s.byr as sire_byr, d.byr as dam_byr,
            case when coalesce(s.sex, 2) in (0, 2) and coalesce(d.sex, 1) in (0, 1) then 1 else 0 end as sexes_fit
            from genotyped g left join ped p on g.animal_id = p.animal_id left join ped s on p.sire_id = s.animal_id left join ped d on p.dam_id = d.animal_id""",
        "identity_mates": "select c.child as a, c.q as b, round(c.rate, 6) as rate from swap_step_1 c",
        **_chain(),
        "swap_prescan": "select c.animal_id as child, s.mate, s.depth, case when s.mate is not null then 'ID_SWAP' else 'CONTINUE' end as found from seek_children c left join swaps s on c.animal_id = s.child",
        # without a swap and without candidates the chain is walked again, on the same genotypes
        "swap_fallback": """select c.animal_id as child, s.mate from seek_children c left join swaps s on c.animal_id = s.child left join (select distinct child from slots) k on c.animal_id = k.child
            where k.child is null and s.mate is null""",
        "seek_outcomes": """select c.animal_id as child, c.source, c.sire_id as old_sire, c.dam_id as old_dam, w.mate,
            case when w.mate is not null then q.sire_id when s.cand is null and d.cand is null then null else coalesce(s.cand, c.sire_id) end as new_sire,
            case when w.mate is not null then q.dam_id when s.cand is null and d.cand is null then null else coalesce(d.cand, c.dam_id) end as new_dam,
            case when w.mate is not null then 'ID_SWAP' when coalesce(s.n, 0) > 1 or coalesce(d.n, 0) > 1 then 'MULTI_RESOLVED' when s.cand is not null or d.cand is not null then 'PARENT_UPDATE' else 'NOT_FOUND' end as outcome
            from seek_children c left join swaps w on c.animal_id = w.child left join ped q on w.mate = q.animal_id
            left join (select * from slot_ranks where slot = 'sire' and k = 1) s on c.animal_id = s.child left join (select * from slot_ranks where slot = 'dam' and k = 1) d on c.animal_id = d.child""",
        "seek_outcome": "select child, new_sire, new_dam, outcome from seek_outcomes",
        # a swapped sample takes its mate's id; several candidates may be a reason to delete
        "seek_normalize": "select child, coalesce(mate, child) as final_id, case when outcome = 'MULTI_RESOLVED' and $multi_action = 1 then 2 else 0 end as action from seek_outcomes",
        "seek_changes": """select *, case when mate is not null or coalesce(old_sire, -1) <> coalesce(new_sire, -1) or coalesce(old_dam, -1) <> coalesce(new_dam, -1) then 'CHANGED' else 'NOCHANGE' end as change
            from seek_outcomes where not (outcome = 'MULTI_RESOLVED' and $multi_action = 1)""",
        "seek_change": "select child, outcome, change from seek_changes",
        # the new parents over all markers: both if both are genotyped, else the one that is
        "post_parents": """select o.child, s.animal_id as sire_row, d.animal_id as dam_row from seek_changes o left join genotyped s on o.new_sire = s.animal_id left join genotyped d on o.new_dam = d.animal_id
            where o.source <> 'SEX' and (s.animal_id is not null or d.animal_id is not null)""",
        "post_errors": """select child, count(*) as n_valid, cast(sum(case when sire_row is not null and dam_row is not null
              then case when gc < (case when gs = 2 then 1 else 0 end) + (case when gd = 2 then 1 else 0 end) or gc > (case when gs >= 1 then 1 else 0 end) + (case when gd >= 1 then 1 else 0 end) then 1 else 0 end
              else case when abs(gc - coalesce(gs, gd)) = 2 then 1 else 0 end end) as bigint) as n_errors
            from (select o.child, o.sire_row, o.dam_row, c.g as gc, s.g as gs, d.g as gd from post_parents o join geno c on o.child = c.animal_id
              left join geno s on o.sire_row = s.animal_id and c.snp_idx = s.snp_idx left join geno d on o.dam_row = d.animal_id and c.snp_idx = d.snp_idx) t
            where gc is not null and (sire_row is null or gs is not null) and (dam_row is null or gd is not null) group by child""",
        "seek_checks": """select c.*, case when e.n_valid is null or e.n_valid < $recheck_min then 'NA' when e.n_errors * 1.0e0 / e.n_valid <= 5 * $animal_error then 'PASS' else 'FAIL' end as post
            from seek_changes c left join post_errors e on c.child = e.child""",
        "seek_post_mendel": "select child, post from seek_checks",
        "parent_seek_cube": "select source, outcome, post, count(*) as n from seek_checks group by cube (source, outcome, post)",
        "seek_report": """select outcome, change, count(*) as n, count(case when source = 'MEN' then 1 end) as mendel, count(case when source = 'SEX' then 1 end) as sex, count(case when source = 'BTH' then 1 end) as both_sources
            from seek_checks group by outcome, change""",
    },
    {"min_age": 1, "compat_min": 100, "compat": "0.95e0", "g_tol": "0.15e0", "swap_min": "0.95e0", "swap_depth": 3, "multi_action": 0},
    {"compat_min": 8, "g_tol": "0.40e0", "swap_min": "0.70e0"},
    steps=("seek_children", "candidates", "slot_ranks", "seek_outcomes", "mates", "swap_step_1", "swap_step_2", "swap_step_3", "mate_profiles"),
)

_number = lambda p, name: float(str(p[name]))
PYTHON["child_scores"] = (("seek_children", "geno", "panel"), lambda p, seek_children, geno, panel: panel_pairs(seek_children, geno, panel, int(p["compat_min"]), _number(p, "compat"), 2.0))
PYTHON["mate_counts"] = (
    ("seek_children", "geno", "panel", "deleted"),
    lambda p, seek_children, geno, panel, deleted: identity_pairs(seek_children, geno, panel, deleted, int(p["compat_min"]), _number(p, "swap_min"), int(p["swap_depth"])),
)

QUERIES = [
    "cand_age_sex", "cand_compat", "cand_g", "candidate_parents", "cand_slot", "best_candidate", "top2_margin", "seek_outcome", "seek_normalize", "seek_change", "seek_post_mendel", "parent_seek_cube", "seek_report",
    "identity_mates", "swap_prescan", "swap_fallback",
]
