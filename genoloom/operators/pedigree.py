"""Pedigree: ingest and merge, guards, roles, generations, renumbering, inbreeding, relationships and their inverse."""

from __future__ import annotations

from ..plans.engine import register

_ROUNDS = 8
_MEND = "case when p.sire_id is null and p.dam_id is null then 1e0 when p.sire_id is null then 0.75e0 - 0.25e0 * coalesce(fd.f, 0e0) when p.dam_id is null then 0.75e0 - 0.25e0 * coalesce(fs.f, 0e0) else 0.5e0 - 0.25e0 * (coalesce(fs.f, 0e0) + coalesce(fd.f, 0e0)) end"


def variance(before: str) -> str:
    """Mendelian sampling variance of each animal from the inbreeding of its parents."""
    return f"select p.animal_id, {_MEND} as d from ped p left join {before} fs on p.sire_id = fs.animal_id left join {before} fd on p.dam_id = fd.animal_id"


def following(before: str) -> str:
    """Inbreeding from contributions and variances: the diagonal of T D T' less 1."""
    return f"select c.animal_id, sum(c.v * c.v * d.d) - 1 as f from contrib c join ({variance(before)}) d on c.ancestor = d.animal_id group by c.animal_id"


register(
    {
        "ped_expand": """select id, sire, dam, sex, byr, role, count(*) as n from (select animal_id as id, sire_id as sire, dam_id as dam, sex, byr, 'animal' as role from ped
            union all select sire_id, null, null, 2, null, 'sire' from ped where sire_id is not null union all select dam_id, null, null, 1, null, 'dam' from ped where dam_id is not null) x
            group by id, sire, dam, sex, byr, role""",
        "ped_sanitize": """select animal_id, case when sire_id = dam_id or sire_id = animal_id then null else sire_id end as sire_id,
            case when sire_id = dam_id or dam_id = animal_id then null else dam_id end as dam_id from ped""",
        "self_parent_guard": "select animal_id, case when sire_id = animal_id then null else sire_id end as sire_id, case when dam_id = animal_id then null else dam_id end as dam_id from ped",
        # records of one id: a parent that all known records agree on, else unknown; the newest known birth year
        "ped_merge": """select id, case when count(distinct sire) = 1 then max(sire) end as sire, case when count(distinct dam) = 1 then max(dam) end as dam, max(byr) as byr,
            coalesce(max(case when role = 'animal' then sex end), case when count(distinct sex) = 1 then max(sex) end) as sex, cast(sum(n) as bigint) as n_records from ped_expand group by id""",
        "role_sex": """select id, case when max(role) = 'sire' and min(role) = 'sire' then 2 when max(role) = 'dam' and min(role) = 'dam' then 1 end as sex
            from ped_expand where role <> 'animal' group by id""",
        "dual_role_ids": "select sire_id as id from ped_roles where sire_id is not null intersect select dam_id from ped_roles where dam_id is not null",
        "sire_dam_intersect": "select sire_id as id from ped intersect select dam_id from ped",
        "valid_id": """select id, substring(id, 1, 1) between '!' and '~' and trim(id) <> '0' and id <> '' as valid from
            (select distinct case when animal_id < 9 then '0' when animal_id < 19 then '' when animal_id < 29 then concat('é', cast(animal_id as varchar(9))) else concat('A', cast(animal_id as varchar(9))) end as id from ped) i""",
        "ref_distinct": "select distinct id from refs",
        "ref_seed": "select coalesce(p.animal_id, r.id) as id, r.id is not null as is_ref, p.animal_id is null as added from ped p full outer join ref_distinct r on p.animal_id = r.id",
        "ref_stats": """select (select count(*) from refs) as valid_refs, (select count(*) from ref_distinct) as unique_refs, (select count(*) from refs) - (select count(*) from ref_distinct) as duplicate_refs,
            (select count(*) from ref_distinct r join ped p on r.id = p.animal_id) as found, (select count(*) from ref_distinct r left join ped p on r.id = p.animal_id where p.animal_id is null) as missing,
            (select count(*) from (select distinct r.id from refs r join ped p on r.id = p.animal_id where r.sex <> p.sex) x) as sex_conflicts""",
        # generations count from the youngest: a parent is one more than its oldest child
        "generations": {
            "duckdb": """/*recursive*/ select animal_id, 0 as gen from ped union select p.parent, g.gen + 1 from generations g join
                (select animal_id, sire_id as parent from ped where sire_id is not null union all select animal_id, dam_id from ped where dam_id is not null) p on g.animal_id = p.animal_id""",
            "spark": "select animal_id, gen from traced",
        },
        "trace_generation": "select animal_id, max(gen) as gen from generations group by animal_id",
        "traced_from_refs": "select t.animal_id, t.gen from trace_generation t join ref_distinct r on t.animal_id = r.id",
        "prune_untraced": "select p.animal_id from ped p join ref_distinct r on p.animal_id = r.id",
        "renumber_order": """select p.animal_id, row_number() over (order by p.byr * 100 + (100 - t.gen), cast(p.animal_id as varchar(20))) as nid from ped p join trace_generation t on p.animal_id = t.animal_id""",
        "parent_number_map": "select o.nid, s.nid as sire_nid, d.nid as dam_nid from renumber_order o join ped p on o.animal_id = p.animal_id left join renumber_order s on p.sire_id = s.animal_id left join renumber_order d on p.dam_id = d.animal_id",
        "renumber": "select o.nid, m.sire_nid, m.dam_nid, p.sex, p.byr, t.gen, p.animal_id from renumber_order o join parent_number_map m on o.nid = m.nid join ped p on o.animal_id = p.animal_id join trace_generation t on p.animal_id = t.animal_id",
        # contributions of ancestors, by halves along every path
        "paths": {
            "duckdb": """/*recursive*/ select animal_id, animal_id as ancestor, 1e0 as v from ped union all select w.animal_id, p.parent, w.v / 2 from paths w join
                (select animal_id, sire_id as parent from ped where sire_id is not null union all select animal_id, dam_id from ped where dam_id is not null) p on w.ancestor = p.animal_id""",
            "spark": "select animal_id, ancestor, v from walked",
        },
        "contrib": "select animal_id, ancestor, sum(v) as v from paths group by animal_id, ancestor",
        "ancestor_contrib": "select animal_id, ancestor, round(v, 6) as v from contrib",
        "f0": "select animal_id, 0e0 as f from ped",
        **{f"f{n}": following(f"f{n - 1}") for n in range(1, _ROUNDS)},
        "inbreeding": {"duckdb": f"select * from f{_ROUNDS - 1}", "spark": "select * from settled"},
        "inbreeding_f": "select animal_id, round(f, 6) as f from inbreeding",
        "inbreeding_summary": """select count(case when f > 1e-6 then 1 end) as above_6, count(case when f > 1e-12 then 1 end) as above_12, round(min(case when f > 1e-12 then f end), 6) as min_positive,
            round(max(f), 6) as max_f, round(sum(f), 6) as sum_f from inbreeding""",
        "variances": variance("inbreeding"),
        "mendelian_d": "select animal_id, round(d, 6) as d from variances",
        "a_matrix": {
            "duckdb": """select x.animal_id as i, y.animal_id as j, round(sum(x.v * y.v * d.d), 6) as a from contrib x join contrib y on x.ancestor = y.ancestor and x.animal_id >= y.animal_id
                join variances d on x.ancestor = d.animal_id group by x.animal_id, y.animal_id""",
            "spark": "select i, j, round(a, 6) as a from a_columns",
        },
        # the matrix times a vector, without the matrix
        "a_vector": "select animal_id, byr - 2000e0 as x from ped",
        "a_full": "select x.animal_id as i, y.animal_id as j, sum(x.v * y.v * d.d) as a from contrib x join contrib y on x.ancestor = y.ancestor join variances d on x.ancestor = d.animal_id group by x.animal_id, y.animal_id",
        "colleau_apply": {"spark": "select animal_id, round(y, 4) as y from a_times", "duckdb": "select a.i as animal_id, round(sum(a.a * x.x), 4) as y from a_full a join a_vector x on a.j = x.animal_id group by a.i"},
        "inbreeding_levels": {"spark": "select animal_id, round(f, 6) as f from levelled", "duckdb": "select animal_id, round(f, 6) as f from inbreeding"},
        "inbreeding_tabular": {"spark": "select animal_id, round(f, 6) as f from tabled", "duckdb": "select a.i as animal_id, round(a.a - 1, 6) as f from a_full a where a.i = a.j"},
        # a link is cleared if the parent descends from the animal
        "cyclic_links": "select animal_id, sire_id as parent from ped_cyclic where sire_id is not null union select animal_id, dam_id from ped_cyclic where dam_id is not null",
        "cyclic_reach": "/*recursive*/ select animal_id, parent from cyclic_links union select r.animal_id, l.parent from cyclic_reach r join cyclic_links l on r.parent = l.animal_id",
        "cycle_guard": {
            "spark": "select animal_id, sire_id, dam_id from guarded",
            "duckdb": """select p.animal_id, case when s.animal_id is null then p.sire_id end as sire_id, case when d.animal_id is null then p.dam_id end as dam_id from ped_cyclic p
                left join cyclic_reach s on s.animal_id = p.sire_id and s.parent = p.animal_id left join cyclic_reach d on d.animal_id = p.dam_id and d.parent = p.animal_id""",
        },
        # six terms of each animal, one over its variance times 1, -1/2 or 1/4, summed by place
        "a_terms": """select v.animal_id, 1e0 / v.d as b, p.sire_id, p.dam_id from variances v join ped p on v.animal_id = p.animal_id where v.d > 1e-14""",
        "a_entries": """select animal_id as i, animal_id as j, b as v from a_terms union all select greatest(animal_id, sire_id), least(animal_id, sire_id), -0.5e0 * b from a_terms where sire_id is not null
            union all select greatest(animal_id, dam_id), least(animal_id, dam_id), -0.5e0 * b from a_terms where dam_id is not null union all select sire_id, sire_id, 0.25e0 * b from a_terms where sire_id is not null
            union all select dam_id, dam_id, 0.25e0 * b from a_terms where dam_id is not null
            union all select greatest(sire_id, dam_id), least(sire_id, dam_id), (case when sire_id = dam_id then 0.5e0 else 0.25e0 end) * b from a_terms where sire_id is not null and dam_id is not null""",
        "a_inv": "select i, j, sum(v) as v from a_entries group by i, j having abs(sum(v)) > 1e-16",
        "add_ainv": "select least(i, j) as i, greatest(i, j) as j, count(*) as terms, round(sum(v), 6) as v from a_entries group by least(i, j), greatest(i, j)",
        "a_inverse": "select i, j, round(v, 6) as v from a_inv",
        "sparse_accumulate": "select least(i, j) as i, greatest(i, j) as j, round(sum(v), 6) as v from a_entries group by least(i, j), greatest(i, j)",
        "key_accumulate": "select i * 1000000 + j as k, round(sum(v), 6) as v from a_entries group by i * 1000000 + j having abs(sum(v)) > 1e-16",
        "pcg": {"spark": "select i as animal_id, round(x, 1) as x from solved"},
        # the matrix times the solution is the right side again
        "pcg_check": {
            "spark": """select animal_id, cast(round(sum(v * x)) as int) as y from (select a.i as animal_id, a.v, s.x from a_inv a join solved s on a.j = s.i
                union all select a.j, a.v, s.x from a_inv a join solved s on a.i = s.i where a.i <> a.j) t group by animal_id""",
            "duckdb": "select animal_id, byr as y from ped",
        },
        "csr_matvec": "select animal_id, y from matvec",
        # rows of the upper triangle, each with the place of its first entry
        "csr_upper": "select least(i, j) as i, greatest(i, j) as j, sum(v) as v from a_entries group by least(i, j), greatest(i, j)",
        "csr_rows": "select i, count(*) as n from csr_upper group by i",
        "csr_build": """select e.i, r.start + row_number() over (partition by e.i order by e.j) as place, e.j, round(e.v, 6) as v from csr_upper e
            join (select i, cast(coalesce(sum(n) over (order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as start from csr_rows) r on e.i = r.i""",
        # a symmetric product with the vector of birth years
        "matvec": """select i as animal_id, round(sum(v * x), 4) as y from (select a.i, a.v, p.byr * 1e0 as x from a_inv a join ped p on a.j = p.animal_id
            union all select a.j, a.v, p.byr * 1e0 from a_inv a join ped p on a.i = p.animal_id where a.i <> a.j) t group by i""",
    },
    steps=("inbreeding", "variances", "a_terms", "a_entries", "ref_distinct", "trace_generation", "renumber_order"),
)

QUERIES = [
    "ped_expand", "ped_sanitize", "self_parent_guard", "ped_merge", "role_sex", "dual_role_ids", "sire_dam_intersect", "valid_id", "ref_distinct", "ref_seed", "ref_stats", "prune_untraced", "cycle_guard",
    "trace_generation", "traced_from_refs", "renumber_order", "parent_number_map", "renumber", "ancestor_contrib", "inbreeding_f", "inbreeding_levels", "inbreeding_tabular", "inbreeding_summary", "mendelian_d",
    "a_matrix", "colleau_apply", "a_inverse", "add_ainv", "sparse_accumulate", "key_accumulate", "csr_build", "csr_matvec", "matvec", "pcg_check",
]
