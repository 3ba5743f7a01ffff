"""SQL that computes the registered queries independently.

``CTES`` are building blocks; ``sql`` puts in front of a query those it names, directly or not.
"""

from __future__ import annotations

import re

from shelfkin.functions.text import ENGLISH_STOP_WORDS
from shelfkin.operators import prompts as P

STOP = "[" + ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS) + "]"
# Python's white space, listed by property and control characters.
NO_SPACE = r"[^\pZ\x09-\x0d\x1c-\x1f\x{85}]+"
FIRST_WORD = f"regexp_extract(review_rating, '{NO_SPACE}')"
NUM = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def clean(x: str) -> str:
    return (
        f"lower(trim(regexp_replace(regexp_replace(coalesce({x}, ''), '<[^>]+>', '', 'g'), "
        r"'[^\p{L}\p{N}_]+', ' ', 'g')))"
    )


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda x: length(x) >= 2 and not list_contains({STOP}, x))"


def numeric(x: str) -> str:
    v = f"(case when regexp_matches({x}, '{NUM}') then try_cast(trim({x}) as double) end)"
    return f"(case when abs({v}) < 'infinity'::double then {v} end)"


def price_text(x: str) -> str:
    return f"try_cast(nullif(regexp_replace({x}, '[^0-9.]', '', 'g'), '') as double)"


def money(x: str) -> str:
    return f"(case when {x} > 0 and not isnan({x}) then '$' || format('{{:.2f}}', {x}) else 'N/A' end)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _term_ctes(p: str, source: str, ids: str) -> dict[str, str]:
    """Terms, vocabulary, weights and neighbours over ``source(id, text)``, names prefixed."""
    return {
        f"{p}words": f"select id, {words('clean')} words from (select id, {clean('text')} clean from {source})",
        f"{p}tokens": f"select id, unnest(words) w, generate_subscripts(words, 1) pos from {p}words",
        f"{p}grams": f"""select id, w term from {p}tokens union all
            select id, w || ' ' || nxt from (select id, w, lead(w) over (partition by id order by pos) nxt
            from {p}tokens) where nxt is not null""",
        f"{p}tf": f"select id, term, count(*) n from {p}grams group by 1, 2",
        f"{p}vocab": f"""select term, cf, df, ln((1 + (select count(*) from {ids})) / (1 + df)) + 1 idf
            from (select term, sum(n)::bigint cf, count(*) df from {p}tf group by 1)
            where df >= 2 order by cf desc, term limit 5000""",
        f"{p}weights": f"""select id, term, x / sqrt(sum(x * x) over (partition by id)) weight
            from (select id, term, n * idf x from {p}tf join {p}vocab using (term))""",
        f"{p}scores": f"""select * from (select a.id, b.id rec_id, round(sum(a.weight * b.weight), 6) score
            from {p}weights a join {p}weights b on a.term = b.term and a.id <> b.id group by 1, 2) where score > 0""",
        f"{p}nb": f"""select id, rec_id, score, rank from (select *, row_number() over
            (partition by id order by score desc, rec_id)::int rank from {p}scores) where rank <= 5""",
        f"{p}head": f"select id rec_id from {ids} order by 1 limit 6",
        f"{p}padded": f"""select id, rec_id, score, rank from (select *, row_number() over
            (partition by id order by score desc, rec_id)::int rank from (
              select id, rec_id, score from {p}nb union all
              select i.id, f.rec_id, 0.0 from {ids} i join {p}head f on i.id <> f.rec_id
              where not exists (select 1 from {p}nb x where x.id = i.id and x.rec_id = f.rec_id)))
            where rank <= 5""",
    }


def _evaluation_ctes(p: str, cat: str) -> dict[str, str]:
    def sample(n: int) -> str:
        return f"select id from {cat} order by md5('42' || id::varchar), id limit {n}"

    def relevance(n: int) -> str:
        return f"""select n.*, coalesce(lower(s.brand) <> '' and lower(s.brand) = lower(t.brand), false) relevant,
            t.review_count popularity from {p}padded n join {cat} s using (id)
            join {cat} t on t.id = n.rec_id where n.id in ({sample(n)})"""

    return {
        f"{p}split": f"""select id, avg_rating, case when row_number() over (order by md5(id::varchar), id)
            <= ceil(count(*) over () * 0.2::double) then 'test' else 'train' end part
            from {cat} where avg_rating > 0""",
        f"{p}pred": f"""select s.id, s.avg_rating actual, round(p.predicted, 6) predicted from {p}split s left join (
              select n.id, sum(c.avg_rating * n.score) / sum(n.score) predicted from {p}nb n
              join {cat} c on c.id = n.rec_id where c.avg_rating > 0 and n.score > 0 group by 1) p using (id)
            where s.part = 'test'""",
        f"{p}errors": f"""select round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) rmse,
            round(avg(abs(actual - predicted)), 6) mae,
            round(sqrt(avg((actual - m) * (actual - m)) filter (predicted is not null)), 6) baseline_rmse,
            round(avg(abs(actual - m)) filter (predicted is not null), 6) baseline_mae,
            count(predicted) n_predictions, count(*) n_test_products,
            case when (select count(*) from {p}split) < 10 then 'Not enough products with ratings for evaluation'
              when count(predicted) = 0 then 'Could not generate predictions' else 'ok' end status
            from {p}pred, (select avg(avg_rating) m from {p}split where part = 'train')""",
        f"{p}rel100": relevance(100),
        f"{p}rel50": relevance(50),
        f"{p}ranking": f"""select round(avg(p), 6) precision_at_k, round(avg(ndcg), 6) ndcg_at_k,
            round(sum(pop) / sum(n), 6) avg_popularity, count(*) n_samples,
            round((select count(distinct rec_id) from {p}rel100) / (select count(*) from {cat}), 6) coverage, 5 k
            from (select id, avg(relevant::int) p, sum(relevant::int / log2(rank + 1)) / sum(1 / log2(rank + 1)) ndcg,
              sum(popularity) pop, count(*) n from {p}rel100 group by 1)""",
        f"{p}quality": f"""select round(avg(share), 6) avg_brand_consistency, round(avg(score), 6) avg_similarity_score,
            round(coalesce(avg(matched), 0), 6) avg_matched_score, count(*) n_samples, 5 n_recommendations
            from (select id, avg(relevant::int) share, avg(score) score, avg(score) filter (relevant) matched
              from {p}rel50 group by 1)""",
    }


def _context(hits: str) -> str:
    """``(query_id, context)`` of the first three rows of ``hits`` per query."""
    return f"""select query_id, string_agg('Product ' || rank || ':' || chr(10) || '  Name: ' || name || chr(10) || '  Brand: '
          || brand || chr(10) || '  Price: ' || {money('price')} || chr(10) || '  Rating: ' ||
          format('{{:.1f}}', avg_rating) || '/5 (' || review_count || ' reviews)' || chr(10) || '  Relevance: ' ||
          format('{{:.1f}}', relevance_score * 100) || '%' || chr(10) || case when reviews_snippet <> '' then
          '  Customer feedback: ' || substr(reviews_snippet, 1, 150) || '...' || chr(10) else '' end,
          chr(10) order by rank) context from {hits} where rank <= 3 group by 1"""


def _unit_vectors(source: str, key: str) -> str:
    """``(key, place, v)`` of hashed words of ``source(key, text)``."""
    return f"""select {key}, place::int place, n / sqrt(sum(n * n) over (partition by {key})) v from (
        select {key}, (code >> 1) % 64 place, sum(2 * (code % 2) - 1) n from (
          select {key}, ('0x' || substr(md5(w), 1, 8))::bigint code from (
            select {key}, unnest(regexp_extract_all(lower(text), '{NO_SPACE}')) w from {source})) group by 1, 2)"""


CTES: dict[str, str] = {
    "retail_reviews": """select l_partkey id, l_partkey::varchar asins, p_brand brand, p_type categories,
        p_name name, '[{"amountMax":' || p_retailprice::decimal(10,2)::varchar || '}]' prices,
        p_brand manufacturer, '<p>' || o_orderpriority || '</p> returned: ' || l_returnflag || '/' || l_linestatus
        review_text, o_orderpriority review_title, ceil(l_quantity / 10)::bigint::varchar || '.0 of 5' review_rating,
        o_custkey::varchar username, l_orderkey * 8 + l_linenumber ord
        from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey""",
    "retail_rated": rf"""select *, {numeric(FIRST_WORD)} rating,
        {clean('review_text')} clean from retail_reviews""",
    "retail": rf"""select id, min_by(name, ord) name, min_by(brand, ord) brand, min_by(categories, ord) categories,
        min_by(manufacturer, ord) manufacturer, min_by(asins, ord) asins,
        try_cast(regexp_extract(min_by(prices, ord), '"amountMax":(\d+\.?\d*)', 1) as double) price,
        {clean('min_by(name, ord)')} name_clean, {clean('min_by(categories, ord)')} categories_clean,
        {clean('min_by(brand, ord)')} brand_clean,
        {clean('min_by(name, ord)')} || ' ' || {clean('min_by(categories, ord)')} || ' ' || {clean('min_by(brand, ord)')}
        content, substr(string_agg(clean, ' ' order by ord, clean), 1, 2000) reviews_head,
        string_agg(clean, ' ' order by ord, clean) all_reviews, coalesce(avg(rating), 0) avg_rating,
        count(rating) review_count, count(distinct username) unique_reviewers from retail_rated group by id""",
    "retail_parts": """select *, (row_number() over (partition by id order by ord, clean) - 1) // 4096 part
        from retail_rated""",
    "retail_items": "select id, content || ' ' || all_reviews as text from retail",
    "sales": """select doc_id::varchar product_id, source || ' item ' || doc_id product_name,
        lang || '|' || source category, case when lang <> 'en' then '₹' || format('{:,}', n_chars) end discounted_price,
        '$' || format('{:,}', n_chars) || '.50' actual_price, '10%' discount_percentage,
        (1 + 3 * quality)::varchar || '.5' rating, case when lang <> 'de' then format('{:,}', n_chars) end rating_count,
        d.text about_product, null::varchar img_link, role review_title, c.text review_content, role user_name,
        doc_id * 1024 + coalesce(turn, 0) ord
        from documents d left join labels using (doc_id) left join conversations c on c.conv_id = d.doc_id""",
    "sales_products": r"""select product_id id, min(product_name) as name, min(category) categories,
        min(discounted_price) discounted_price, min(actual_price) actual_price, min(rating) rating,
        min(rating_count) rating_count, min(about_product) about_product,
        min(regexp_extract(product_name, 'NO_SPACE')) brand, min(product_id) asins,
        min(regexp_extract(product_name, 'NO_SPACE')) manufacturer, count(distinct user_name) unique_reviewers,
        string_agg(CLEAN, ' ' order by ord, CLEAN) all_reviews from sales group by 1""".replace(
        "CLEAN", clean("review_content")
    ).replace("NO_SPACE", NO_SPACE),
    "sales_catalog": f"""select id, name, brand, categories, manufacturer, asins,
        coalesce({price_text('discounted_price')}, {price_text('actual_price')}) price,
        {clean('name')} name_clean, {clean("replace(categories, '|', ' ')")} categories_clean,
        {clean('brand')} brand_clean,
        {clean('name')} || ' ' || {clean("replace(categories, '|', ' ')")} || ' ' || {clean('brand')} || ' ' ||
        {clean('about_product')} as content, substr(all_reviews, 1, 2000) reviews_head,
        coalesce({numeric('rating')}, 0.0) avg_rating,
        coalesce(try_cast(regexp_replace(rating_count, '[^0-9]', '', 'g') as bigint), 0) review_count,
        unique_reviewers from sales_products""",
    "cat": f"""select d.doc_id id, 'doc ' || d.doc_id as name, source brand, lang categories, null::double price,
        coalesce(1.0 + 3.0 * quality + (case when toxic = 1 then 0.0 else 1.0 end), 0.0)::double avg_rating,
        n_chars review_count, substr({clean('text')}, 1, 2000) reviews_head
        from documents d left join labels l on d.doc_id = l.doc_id""",
    "items": "select doc_id id, text from documents",
    "pairs": "select id source_id, rec_id target_id from nb",
    "together": """select 'retail' dataset, id, name, brand, avg_rating, review_count from retail
        union all select 'text', id, name, brand, avg_rating, review_count from cat""",
    "facts": """select dataset, count(*) total_products, sum(review_count)::bigint total_reviews,
        round(avg(avg_rating), 6) avg_rating, count(*) filter (avg_rating > 0) rated_products,
        round(count(*) filter (avg_rating > 0) / count(*) * 100, 6) rated_percent from together group by 1""",
    "met": """select source_id, target_id, s.term feature, s.weight source_weight, t.weight target_weight,
        round(s.weight * t.weight, 6) combined from pairs join weights s on s.id = source_id
        join weights t on t.id = target_id and t.term = s.term""",
    "shared": """select source_id, target_id, feature, round(source_weight, 6) source_weight,
        round(target_weight, 6) target_weight, combined, rank from (select *, row_number() over
        (partition by source_id, target_id order by combined desc, feature)::int rank from met) where rank <= 10""",
    "bg": """select term, sum(weight) / 100 mean from weights
        where id in (select id from items order by id limit 100) group by 1""",
    "shap_terms": """select source_id, target_id, s.term feature, s.weight * (coalesce(t.weight, 0) - coalesce(mean, 0)) v,
        s.weight * coalesce(mean, 0) b, s.weight * coalesce(t.weight, 0) c from pairs
        join weights s on s.id = source_id left join weights t on t.id = target_id and t.term = s.term
        left join bg on bg.term = s.term""",
    "shap": """select source_id, target_id, feature, value, rank, base_value, similarity_score from (
        select source_id, target_id, feature, round(v, 6) as value, row_number() over (partition by source_id, target_id
          order by abs(round(v, 6)) desc, feature)::int rank from shap_terms where v <> 0)
        join (select source_id, target_id, round(sum(b), 6) base_value, round(sum(c), 6) similarity_score
          from shap_terms group by 1, 2) using (source_id, target_id) where rank <= 10""",
    "vec": """select vec_id id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding,
        lambda y: y::double * y::double)))) e from embeddings""",
    "topk": """select query_id, id, relevance_score, rank from (select *, row_number() over (partition by query_id
        order by relevance_score desc, id)::int rank from (select q.id query_id, c.id,
        round(list_dot_product(q.e, c.e), 6) relevance_score from vec q, vec c)) where rank <= 5""",
    "cards": f"""select id, coalesce(name, '') as name, coalesce(brand, '') brand, coalesce(price, 0) price, avg_rating,
        review_count, substr(reviews_head, 1, 300) reviews_snippet from cat""",
    "hits": """select query_id, id, name, brand, price, avg_rating, review_count, reviews_snippet, relevance_score, rank
        from topk join cards using (id)""",
    "context": f"""select q.vec_id query_id, coalesce(context, {lit(P.NO_HITS)}) context from embeddings q
        left join ({_context('hits')}) h on h.query_id = q.vec_id""",
    "message_topk": """select query_id, id, relevance_score, rank from (select *, row_number() over (partition by query_id
        order by relevance_score desc, id)::int rank from (select m.request_id query_id, i.id,
        round(coalesce(s, 0), 6) + 0.0 relevance_score from messages m cross join retail i left join
        (select a.request_id, b.id, sum(a.v * b.v) s from asked a join unit b using (place) group by 1, 2) d
        on d.request_id = m.request_id and d.id = i.id)) where rank <= 5""",
    "message_hits": """select query_id, id, name, brand, coalesce(price, 0) price, avg_rating, review_count,
        substr(reviews_head, 1, 300) reviews_snippet, relevance_score, rank from message_topk join retail using (id)""",
    "message_context": f"""select request_id query_id, coalesce(context, {lit(P.NO_HITS)}) context from messages
        left join ({_context('message_hits')}) h on h.query_id = request_id""",
    "message_requests": """select request_id, request_id query_id, message, name product_name, brand product_brand,
        price product_price, avg_rating product_rating from messages left join retail on retail.id = product_id""",
    "retail_texts": """select id, name || '. Brand: ' || brand || '. ' || content || '. ' || substr(reviews_head, 1, 500) as text
        from retail""",
    "unit": _unit_vectors("retail_texts", "id"),
    "doc_texts": "select doc_id, text from documents",
    "doc_unit": _unit_vectors("doc_texts", "doc_id"),
    "message_texts": "select request_id, message as text from messages",
    "asked": _unit_vectors("message_texts", "request_id"),
    "messages": """select conv_id || '-' || turn request_id, conv_id % (select count(*) from embeddings) query_id,
        text message, conv_id product_id from conversations where role = 'user'""",
    "requests": """select request_id, query_id, message, product_id, name product_name, brand product_brand,
        price product_price, avg_rating product_rating from messages left join cat on cat.id = product_id""",
    **_term_ctes("", "items", "items"),
    **_evaluation_ctes("", "cat"),
    **_term_ctes("r_", "retail_items", "retail"),
    **_evaluation_ctes("r_", "retail"),
}


def sql(query: str) -> str:
    """The query with the building blocks it needs in front of it."""
    order: list[str] = []

    def need(text: str, seen: tuple[str, ...]) -> None:
        for name in CTES:
            if name not in order and name not in seen and re.search(rf"\b(from|join)\s+{name}\b", text):
                need(CTES[name], (*seen, name))
                order.append(name)

    need(query, ())
    blocks = ",\n".join(f"{name} as materialized ({CTES[name]})" for name in order)
    return f"with {blocks}\n{query}" if blocks else query
