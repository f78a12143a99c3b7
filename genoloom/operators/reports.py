"""FinalReport records: allele coding, per-record quality, lookups against the pedigree, yields per animal and chromosome."""

from __future__ import annotations

from ..plans.engine import register

register(
    {
        # first character in upper case; AB alleles as they are, else A and T against G and C
        "allele_to_ab": """select allele1_raw, allele2_raw, $allele_mode as mode,
            case when $allele_mode = 'ab' then case upper(substring(allele1_raw, 1, 1)) when 'A' then 'A' when 'B' then 'B' else '?' end
              else case when upper(substring(allele1_raw, 1, 1)) in ('A', 'T') then 'A' when upper(substring(allele1_raw, 1, 1)) in ('G', 'C') then 'B' else '?' end end as ab1,
            case when $allele_mode = 'ab' then case upper(substring(allele2_raw, 1, 1)) when 'A' then 'A' when 'B' then 'B' else '?' end
              else case when upper(substring(allele2_raw, 1, 1)) in ('A', 'T') then 'A' when upper(substring(allele2_raw, 1, 1)) in ('G', 'C') then 'B' else '?' end end as ab2,
            count(*) as n from fr group by allele1_raw, allele2_raw""",
        "genotype_code": """select allele1, allele2, case when concat(allele1, allele2) = 'AA' then 0 when concat(allele1, allele2) in ('AB', 'BA') then 1
            when concat(allele1, allele2) = 'BB' then 2 else 9 end as code, count(*) as n from fr group by allele1, allele2""",
        # a missing metric counts as 1 and passes; cluster separation and GT are tested only with a threshold above 0
        "fr_records": """select *, coalesce(r_intensity, 1.0) < $r_min or coalesce(r_intensity, 1.0) > $r_max as fail_r, coalesce(gc_score, 1.0) < $gc_min as fail_gc,
            $gt_min > 0 and coalesce(gt_score, 1.0) < $gt_min as fail_gt, $sep_min > 0 and coalesce(cluster_sep, 1.0) < $sep_min as fail_sep,
            case when allele1 = 'A' and allele2 = 'A' then 0 when allele1 in ('A', 'B') and allele2 in ('A', 'B') and allele1 <> allele2 then 1
              when allele1 = 'B' and allele2 = 'B' then 2 end as called from fr""",
        "fr_calls": "select *, case when not (fail_r or fail_gc or fail_gt or fail_sep) then called end as g from fr_records",
        "fr_record_qc": """select fail_r, fail_gc, fail_gt, fail_sep, coalesce(g, 9) as code, count(*) as n from fr_calls group by fail_r, fail_gc, fail_gt, fail_sep, coalesce(g, 9)""",
        "fr_animal_yield": """select sample_key, cast(sum(case when fail_r then 1 else 0 end) as bigint) as n_fail_r, cast(sum(case when fail_gc then 1 else 0 end) as bigint) as n_fail_gc,
            cast(sum(case when fail_gt then 1 else 0 end) as bigint) as n_fail_gt, cast(sum(case when fail_sep then 1 else 0 end) as bigint) as n_fail_sep,
            count(g) as n_valid, count(*) as n_records, round(count(g) * 1.0e0 / count(*), 6) as call_rate,
            case when count(g) * 1.0e0 / count(*) >= $animal_cr then 'PASS' else 'FAIL' end as status from fr_calls group by sample_key""",
        "animal_cr_filter": "select sample_key, n_valid, call_rate from fr_animal_yield where $animal_cr <= 0 or status = 'PASS'",
        "fr_map": "select part_key, 1 + part_key % 20 as chr from (select distinct snp_key as part_key from fr) k",
        "fr_chr_yield": """select m.chr, f.sample_key, count(f.g) as n_valid, count(*) as n_records from fr_calls f join fr_map m on f.snp_key = m.part_key group by m.chr, f.sample_key""",
        # a sample is looked up as an id, then as a registration number, else its raw key stays
        "fr_ids": "select distinct 3 * animal_id as id, 3 * animal_id + 1 as arn from ped",
        "fr_ped_lookup": """select s.sample_key, coalesce(i.id, a.id) as ped_id, case when i.id is not null then 'ID' when a.id is not null then 'ARN' else 'RAW' end as found_by,
            coalesce(i.id, a.id, s.sample_key) as animal_key
            from (select distinct sample_key from fr) s left join fr_ids i on s.sample_key = i.id left join fr_ids a on s.sample_key = a.arn""",
        # runs of records of one animal in a file's order: a new run starts a new animal
        "fr_runs": """select file, ord, sample_key, sum(fresh) over (partition by file order by ord rows between unbounded preceding and current row) as run_no from (
            select file, ord, sample_key, case when lag(sample_key) over (partition by file order by ord) = sample_key then 0 else 1 end as fresh from fr_rows) f""",
        "fr_record_seq": "select file, ord, sample_key, cast(run_no as bigint) as run_no, row_number() over (partition by file, run_no order by ord) as seq from fr_runs",
        # records of a run meet the markers of the same ordinal number
        "fr_map_position": """select s.file, s.ord, s.sample_key, m.snp_id, m.chr from fr_record_seq s join
            (select snp_id, chr, row_number() over (order by snp_idx) as seq from snp_map) m on s.seq = m.seq""",
    },
    {"allele_mode": "'top'", "r_min": "0.2e0", "r_max": "2.0e0", "gc_min": "0.15e0", "gt_min": "0.15e0", "sep_min": "0.30e0", "animal_cr": "0.70e0"},
    {"gc_min": "0.65e0", "animal_cr": "0.3e0"},
)

QUERIES = ["allele_to_ab", "genotype_code", "fr_record_qc", "fr_animal_yield", "animal_cr_filter", "fr_chr_yield", "fr_ped_lookup", "fr_record_seq", "fr_map_position"]
