"""Mendelian inconsistencies of duos and trios, per marker, per animal, and what follows for the animal."""

from __future__ import annotations

from ..plans.engine import register

_TRIO = "(case when gs = 2 then 1 else 0 end) + (case when gd = 2 then 1 else 0 end)", "(case when gs >= 1 then 1 else 0 end) + (case when gd >= 1 then 1 else 0 end)"
#: an opposite homozygote against one parent; outside what the gametes of both allow
_ERROR = f"""case when gc is null or (gs is null and gd is null) then null when gd is null then case when abs(gc - gs) = 2 then 1 else 0 end
    when gs is null then case when abs(gc - gd) = 2 then 1 else 0 end when gc < {_TRIO[0]} or gc > {_TRIO[1]} then 1 else 0 end"""

register(
    {
        "genotyped": "select animal_id from geno group by animal_id",
        "relations_of": """select p.animal_id, p.sex, s.animal_id as sire_row, d.animal_id as dam_row, case when s.animal_id is not null and d.animal_id is not null then 'trio'
            when s.animal_id is not null or d.animal_id is not null then 'duo' else 'none' end as kind, p.sire_id, p.dam_id
            from ped p join genotyped g on p.animal_id = g.animal_id left join genotyped s on p.sire_id = s.animal_id left join genotyped d on p.dam_id = d.animal_id""",
        "child_parent": "select animal_id, sire_row, dam_row, kind from relations_of",
        "family_cells": """select r.animal_id, c.snp_idx, c.g as gc, s.g as gs, d.g as gd from relations_of r join geno c on r.animal_id = c.animal_id
            left join geno s on r.sire_row = s.animal_id and c.snp_idx = s.snp_idx left join geno d on r.dam_row = d.animal_id and c.snp_idx = d.snp_idx
            join autosome_mask a on c.snp_idx = a.snp_idx and a.autosome = 1 where r.kind <> 'none'""",
        "trio_align": "select snp_idx, gc, gs, gd, count(*) as n from family_cells where gc is not null and gs is not null and gd is not null group by snp_idx, gc, gs, gd",
        "duo_error": "select gc, gs as gp, case when abs(gc - gs) = 2 then 1 else 0 end as error, count(*) as n from family_cells where gc is not null and gs is not null group by gc, gs",
        "trio_error": f"select gc, gs, gd, {_ERROR} as error, count(*) as n from family_cells where gc is not null and gs is not null and gd is not null group by gc, gs, gd",
        "family_errors": f"select animal_id, snp_idx, {_ERROR} as error from family_cells",
        "snp_errors": "select snp_idx, count(error) as n_valid, cast(sum(coalesce(error, 0)) as bigint) as n_errors from family_errors group by snp_idx",
        "mendel_snp_error_rate": "select snp_idx, n_valid, n_errors, round(case when n_valid > 0 then n_errors * 1.0e0 / n_valid else 0e0 end, 6) as rate, n_valid = 0 or n_errors * 1.0e0 / n_valid <= $snp_error as retained from snp_errors",
        "animal_errors": """select e.animal_id, count(e.error) as n_valid, cast(sum(coalesce(e.error, 0)) as bigint) as n_errors from family_errors e
            left join (select snp_idx from snp_errors where n_valid > 0 and n_errors * 1.0e0 / n_valid > $snp_error) x on e.snp_idx = x.snp_idx where x.snp_idx is null group by e.animal_id""",
        "mendel_animal_error_rate": "select animal_id, n_valid, n_errors, round(case when n_valid > 0 then n_errors * 1.0e0 / n_valid else 0e0 end, 6) as rate from animal_errors",
        # too many errors: delete at a low call rate, switch the sex at a mismatch, else clear the parents
        "mendel_actions": """select r.animal_id, case when e.n_valid is null or e.n_valid = 0 or e.n_errors * 1.0e0 / e.n_valid <= $animal_error then 0 when a.cr < $low_cr then 2
            when s.sex_qc = 1 then 3 else 1 end as action, a.cr, coalesce(e.n_valid, 0) as n_valid, coalesce(e.n_errors, 0) as n_errors
            from relations_of r left join animal_errors e on r.animal_id = e.animal_id join animal_rates a on r.animal_id = a.animal_id join sex_checks s on r.animal_id = s.animal_id""",
        "mendel_action": "select animal_id, action from mendel_actions",
        "mendel_counters": """select kind, count(*) as n, cast(sum(case when sire_id is null and dam_id is null then 1 else 0 end) as bigint) as n_unknown,
            cast(sum(case when sire_id is not null and sire_row is null then 1 else 0 end) as bigint) as n_sire_missing, cast(sum(case when dam_id is not null and dam_row is null then 1 else 0 end) as bigint) as n_dam_missing
            from relations_of group by kind""",
        "all_errors": "select animal_id, count(error) as n_valid, cast(sum(coalesce(error, 0)) as bigint) as n_errors from family_errors group by animal_id",
        "mendel_recheck": """select a.animal_id, case when e.n_valid >= $recheck_min and (e.n_errors * 1.0e0 / e.n_valid > 5 * $animal_error or a.cr < $low_cr) then 2 else 1 end as action
            from mendel_actions a join all_errors e on a.animal_id = e.animal_id where a.action = 1""",
    },
    {"snp_error": "0.01e0", "animal_error": "0.01e0", "low_cr": "0.70e0", "recheck_min": 100},
    {"snp_error": "0.28e0", "animal_error": "0.30e0", "low_cr": "0.97e0", "recheck_min": 20},
    steps=("genotyped", "relations_of", "family_errors", "snp_errors", "mendel_actions", "all_errors"),
)

QUERIES = ["child_parent", "trio_align", "duo_error", "trio_error", "mendel_snp_error_rate", "mendel_animal_error_rate", "mendel_action", "mendel_counters", "mendel_recheck"]
