"""Genotype, marker, pedigree and report views that tests and benches derive from the driver's tables."""

from __future__ import annotations

from ..plans.engine import VIEWS, register

_CALL = "case when abs(e) >= 0.30 then null when e < -0.15 + 0.004 * pos then 0 when e < 0.0 + 0.004 * pos then 1 else 2 end as g"

register(
    {
        "geno": {
            "spark": f"select vec_id as animal_id, pos + 1 as snp_idx, {_CALL} from (select vec_id, cast(e as double) e, pos from embeddings lateral view posexplode(embedding) t as pos, e) c",
            "duckdb": f"select vec_id as animal_id, cast(pos + 1 as int) as snp_idx, {_CALL} from (select vec_id, cast(unnest(embedding) as double) e, unnest(range(0, 64)) pos from embeddings) c",
        },
        "snp_map": """select snp_idx, concat('S', cast(snp_idx as varchar(9))) as snp_id, case when snp_idx <= 50 then 1 + (snp_idx - 1) % 18 else 20 end as chr,
            case when snp_idx <= 50 then 1000000 * (1 + cast(floor((snp_idx - 1) / 18) as int)) + snp_idx * 1111 else 1000 * snp_idx end as pos
            from (select distinct snp_idx from geno) s""",
        "ped": """select vec_id as animal_id, case when vec_id >= 40 then 2 * ((vec_id * 31) % cast(floor(vec_id / 8) as bigint)) end as sire_id,
            case when vec_id >= 40 then 2 * ((vec_id * 17) % cast(floor(vec_id / 8) as bigint)) + 1 end as dam_id,
            case when vec_id % 2 = 0 then 2 else 1 end as sex, 2000 + cast(floor(vec_id / 40) as int) as byr, label as breed from embeddings""",
        "fr": """select l_suppkey as sample_key, l_partkey as snp_key, l_returnflag as allele1_raw, l_linestatus as allele2_raw,
            case l_returnflag when 'A' then 'A' when 'N' then 'B' else '-' end as allele1, case l_linestatus when 'O' then 'A' when 'F' then 'B' else '-' end as allele2,
            l_quantity / 25.0 as r_intensity, 1.0 - l_tax * 10 as gc_score, l_discount * 10 as gt_score, l_extendedprice / 100000.0 as cluster_sep from lineitem""",
        # records of several report files in their order
        "fr_rows": "select cast(floor(c_custkey / 100) as bigint) as file, c_custkey as ord, c_nationkey as sample_key from customer",
        "alleles": "select snp_idx, snp_id, substring('ACGTACTG', 1 + snp_idx % 8, 1) as a1, substring('TGCAGTAC', 1 + snp_idx % 8, 1) as a2 from snp_map",
        # addresses with a gap after each sixth marker
        "snp_addresses": "select snp_id, snp_idx + floor(snp_idx / 7) as address from snp_map",
        # a list of reference ids, some of which the pedigree lacks
        "refs": "select sire_id + 100 as id, 2 as sex from ped where sire_id is not null union all select dam_id, 1 from ped where dam_id is not null",
        # founders in cycles of three, two of them tied by a further link, and one of two
        "ped_cyclic": """select animal_id, case when animal_id < 9 then animal_id - animal_id % 3 + (animal_id + 1) % 3 when animal_id in (10, 11) then 21 - animal_id else sire_id end as sire_id,
            case when animal_id = 4 then 0 when animal_id = 9 then 8 else dam_id end as dam_id from ped""",
        # some dams are recorded as sires elsewhere
        "ped_roles": "select animal_id, sire_id, case when animal_id % 7 = 0 then sire_id else dam_id end as dam_id from ped",
        # several rows of one id
        "labelled_rows": "select 40 + animal_id % 30 as id, animal_id as row_id from genotyped",
    }
)

VIEWS.update(("geno", "snp_map", "ped", "fr", "fr_rows", "labelled_rows", "refs", "ped_cyclic", "ped_roles", "snp_addresses", "alleles"))
