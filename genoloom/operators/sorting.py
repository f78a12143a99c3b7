"""Sorting, searching and queues. Spark sorts; what remains of such operators are ranks, bounds and what is first or last."""

from __future__ import annotations

from ..plans.engine import register

register(
    {
        # the order vector of a sorted text column, and of several columns
        "names_of": "select p_partkey as k, p_name as name, p_brand as brand, p_size as size, p_retailprice as price from part",
        "qsort": "select k, name, row_number() over (order by name, k) as place from names_of",
        "sort_multi": "select k, size, price, row_number() over (order by size, price, k) as place from names_of",
        "sort_kv": "select brand as name, size, count(*) as n, row_number() over (order by size, brand) as place from names_of group by brand, size",
        "unique_sorted": "select name, row_number() over (order by name) as place, n from (select name, count(*) as n from names_of group by name) d",
        # place of a key among sorted ones, and the place that it would take
        "probes": "select distinct size + 0.5e0 * (k % 2) as key from names_of",
        "size_runs": "select size * 1e0 as size, count(*) as n from names_of group by size",
        "binary_search": """select p.key, coalesce(max(case when r.size = p.key then 1 else 0 end), 0) as found, cast(1 + coalesce(sum(case when r.size < p.key then r.n end), 0) as bigint) as left_bound
            from probes p left join size_runs r on r.size <= p.key group by p.key""",
        # the last rows of the renumbered pedigree, and the corner of the relationship matrix
        "tail_n": """select nid, sire_nid, dam_nid, animal_id from renumber order by nid desc limit 10""",
        "last_ids": "select animal_id from ped order by animal_id desc limit 10",
        "tail_block": "select a.i, a.j, a.a from a_matrix a join last_ids x on a.i = x.animal_id join last_ids y on a.j = y.animal_id",
        # what a priority queue gives up, largest first, and of equal priority the one that came first
        "heap": "select k, price, row_number() over (order by price desc, k) as popped from names_of",
        # filled places move to the front in their order
        "compact": "select k, size, row_number() over (order by k) as place from names_of where size % 3 <> 0",
    }
)

QUERIES = ["qsort", "sort_multi", "sort_kv", "unique_sorted", "binary_search", "tail_n", "tail_block", "heap", "compact"]
