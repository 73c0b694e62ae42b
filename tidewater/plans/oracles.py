"""DuckDB SQL for the queries, over the same tables."""

from __future__ import annotations

_GENRES = "['Action','Adventure','Animation','Children''s','Comedy','Crime','Documentary','Drama','Fantasy','Film-Noir','Horror','Musical','Mystery','Romance','Sci-Fi','Thriller','War','Western']"

_RAW = """
ev as (select l_orderkey ok, l_linenumber ln, o_custkey u, l_partkey m, cast(1+floor((l_quantity-1)/10) as int) r, cast(epoch(o_orderdate) as bigint) ts,
  (l_orderkey*7+l_linenumber*13)%97 h from lineitem join orders on l_orderkey=o_orderkey),
b as (select *, case h when 0 then concat_ws(',',u,m,r,ts) when 1 then concat_ws('::',u,m,r,ts,'EXTRA_FIELD') when 2 then concat_ws('::',u,m,9,ts)
  when 3 then concat_ws('::',u,m,r,ts*1000) when 4 then concat_ws('::',u,m,r) when 5 then concat_ws('::',u,m+10000000,r,ts) when 6 then concat_ws('::',u,m,r,0)
  when 7 then concat_ws('::',u,m,'x',ts) when 8 then concat_ws('::',u,m,r,ts,'a') when 9 then concat_ws('::',u,m,'',ts) else concat_ws('::',u,m,r,ts) end line from ev),
ru as (select case c_custkey%41 when 0 then concat_ws('::',c_custkey,'X',25,c_custkey%21,zip) when 1 then concat_ws('::',c_custkey,g,30,c_custkey%21,zip)
  when 2 then concat_ws('::',c_custkey,g,25,99,zip) when 3 then concat_ws('::',c_custkey,g,25,c_custkey%21,'') when 4 then concat_ws('|',c_custkey,g,25,c_custkey%21,zip)
  when 5 then concat_ws('::',c_custkey,g,25,c_custkey%21) else concat_ws('::',c_custkey,g,age,c_custkey%21,zip) end line
  from (select c_custkey, case when c_custkey%3=0 then 'F' else 'M' end g, case c_nationkey%7 when 0 then 1 when 1 then 18 when 2 then 25 when 3 then 35 when 4 then 45 when 5 then 50 else 56 end age,
    lpad(cast(c_nationkey*997 as varchar),5,'0') zip from customer) x),
ri as (select case p_partkey%37 when 0 then concat_ws('::',p_partkey,p_name,genres) when 1 then concat_ws('::',p_partkey,concat(p_name,' (1700)'),genres)
  when 2 then concat_ws('::',p_partkey,title,'UnknownGenre') when 3 then concat_ws('::',p_partkey,title,'') when 4 then concat_ws(',',p_partkey,title,genres)
  when 5 then concat_ws('::',p_partkey,title) when 6 then concat_ws('::',p_partkey,title,concat(genres,'|')) else concat_ws('::',p_partkey,title,genres) end line
  from (select p_partkey, p_name, concat(p_name,' (',1940+p_size,')') title, case p_type when 'ECONOMY' then 'Comedy|Romance' when 'MEDIUM' then 'Drama'
    when 'STANDARD' then 'Action|Sci-Fi|Thriller' when 'PROMO' then 'Horror' when 'SMALL' then 'Children''s|Animation' else 'Western|War' end genres from part) x),
raw as (select 'ratings' kind, line from b union all select 'ratings', line from b where h=20 union all select 'ratings', concat_ws('::',u,m,r%5+1,ts) from b where h=21
  union all select 'users', line from ru union all select 'movies', line from ri),
rf as (select kind, line, string_split(line,'::') f, case kind when 'ratings' then 4 when 'users' then 5 else 3 end w from raw),
uid as (select distinct regexp_extract(line,'^([0-9]+)',1) id from raw where kind='users' and regexp_matches(line,'^[0-9]')),
iid as (select distinct regexp_extract(line,'^([0-9]+)',1) id from raw where kind='movies' and regexp_matches(line,'^[0-9]')),
r4 as (select line, f[1] u, f[2] m, f[3] r, f[4] t, case when regexp_full_match(f[4],'[+-]?[0-9]+') then try_cast(f[4] as bigint) end lt,
  case when regexp_full_match(f[3],'[+-]?[0-9]+') then try_cast(f[3] as bigint) end lr from rf where kind='ratings' and len(f)=4)"""

_TAGGED = _RAW + f""",
n0 as (select kind, line, w, string_split(case when contains(line,'::') then line when contains(line,',') then replace(line,',','::') when contains(line,'|') then replace(line,'|','::')
  when contains(line,':') then replace(line,':','::') else line end,'::') f0 from rf),
n1 as (select kind, line, w, case when len(f0)=w+1 and f0[-1]='EXTRA_FIELD' then f0[1:w] else f0 end f from n0),
n2 as (select *, case when kind='ratings' and regexp_full_match(f[4],'[+-]?[0-9]+') then try_cast(f[4] as bigint) end lt, nullif(regexp_extract(f[2],'\\(([0-9]{{4}})\\)',1),'') y from n1),
n3 as (select *, case when lt>100000000000 then lt//1000 else lt end sec from n2),
n4 as (select *, case when len(f)<w then 'missing_fields' when len(f)>w then 'extra_fields'
  when kind='ratings' then case when not (regexp_full_match(f[1],'[0-9]+') and regexp_full_match(f[2],'[0-9]+')) then 'id_not_int' when not regexp_full_match(f[3],'[0-9]+') then 'rating_not_int'
    when coalesce(try_cast(f[3] as int),0) not between 1 and 5 then 'rating_out_of_range' when lt is null then 'ts_not_integer' when sec not between 788918400 and 1009843199 then 'ts_out_of_range'
    when f[1] not in (select id from uid) then 'unknown_user' when f[2] not in (select id from iid) then 'unknown_item' end
  when not regexp_full_match(f[1],'[0-9]+') then 'id_not_int'
  when kind='users' then case when f[2] not in ('F','M') then 'gender_invalid' when f[3] not in ('1','18','25','35','45','50','56') then 'age_invalid'
    when coalesce(try_cast(f[4] as int),-1) not between 0 and 20 then 'occupation_invalid' when trim(f[5])='' then 'zip_missing' end
  when trim(f[2])='' then 'title_missing' when coalesce(y::int not between 1880 and 2010, true) then 'year_invalid' when trim(f[3])='' then 'genres_missing'
  when not list_has_all({_GENRES}, string_split(regexp_replace(f[3],'[|]+$',''),'|')) then 'genre_unknown' end reason from n3),
tg as (select kind, line, reason, case when reason is null then case when kind='ratings' then concat_ws('::',f[1],f[2],f[3],sec) else array_to_string(f,'::') end end cleaned,
  case when reason is null then case when kind='ratings' then concat_ws('::',f[1],f[2],sec) else f[1] end end k from n4),
gk as (select kind, k, count(*) copies, min(cleaned) cleaned, min(cleaned)<>max(cleaned) clash from tg where reason is null group by kind, k),
kept as (select kind, cleaned line from gk where not clash),
qr as (select kind, line, reason from tg where reason is not null union all select distinct kind, cleaned, 'conflict' from tg semi join (select kind, k from gk where clash) using (kind, k) where reason is null)"""

_TYPED = _TAGGED + """,
rt as (select f[1]::bigint user_id, f[2]::bigint item_id, f[3]::int rating, f[4]::bigint ts from (select string_split(line,'::') f from kept where kind='ratings')),
us as (select f[1]::bigint user_id, f[2] gender, f[3]::int age, f[4]::int occupation, f[5] zip from (select string_split(line,'::') f from kept where kind='users')),
im as (select f[1]::bigint item_id, trim(f[2]) title, list_filter(string_split(f[3],'|'), lambda x: x<>'') genres from (select string_split(line,'::') f from kept where kind='movies')),
sp as (select *, case when ts<=915148799 then 'train' when ts<=962409599 then 'val' else 'test' end period from rt),
tu as (select distinct user_id from sp where period='train'), ti as (select distinct item_id from sp where period='train'),
iv as (select * from sp semi join tu using (user_id) semi join ti using (item_id)),
ce as (select period, user_id, item_id, sum(rating)::bigint value from iv group by all),
tc as (select user_id, item_id, value from ce where period='train'),
st as (select user_id, round(avg(rating),6) user_mean, count(*) user_count from sp where period='train' group by 1),
ic as (select item_id, count(*) item_count from sp where period='train' group by 1),
gm as (select round(avg(rating),6) global_mean from sp where period='train'),
lb as (select user_id, (user_id%5-1)::int cluster from tu)"""

_FEATURES = _TYPED + f""",
fe as (select sp.*, (rating>=4)::int label, coalesce(user_mean,global_mean) f1, ln(1+coalesce(item_count,0)) f2,
  list_transform({_GENRES}, lambda g: coalesce(list_contains(genres,g),false)::int) flags, list_position([1,18,25,35,45,50,56], coalesce(age,35))-1 age_code, coalesce(gender,'M') gender, coalesce(occupation,0) occupation,
  user_mean is null cold_user, item_count is null cold_item, gender is null no_demographics
  from sp left join st using (user_id) left join ic using (item_id) left join us using (user_id) left join im using (item_id) cross join gm),
sc as (select period, label, round(f1,6)/5 score from fe)"""

_SCORE = """, {n}x as (select 'k' k, count(*) total, count(*) filter (kind='ratings') nr,
  count(*) filter (case kind when 'ratings' then len(f)=4 and regexp_full_match(f[1],'[0-9]+') and regexp_full_match(f[2],'[0-9]+') and regexp_full_match(f[3],'[0-9]+') and coalesce(try_cast(f[3] as int),0) between 1 and 5 and regexp_full_match(f[4],'[+-]?[0-9]+') and try_cast(f[4] as bigint) is not null
    when 'users' then len(f)=5 and regexp_full_match(f[1],'[0-9]+') and f[2] in ('F','M') and f[3] in ('1','18','25','35','45','50','56') and coalesce(try_cast(f[4] as int),-1) between 0 and 20
    else len(f)=3 and regexp_full_match(f[1],'[0-9]+') and trim(f[2])<>'' and coalesce(nullif(regexp_extract(f[2],'\\(([0-9]{{4}})\\)',1),'')::int between 1880 and 2010,false) and trim(f[3])<>'' and list_has_all({g}, string_split(regexp_replace(f[3],'[|]+$',''),'|')) end) acc,
  count(*) filter (len(f)=w and len(list_filter(f, lambda x: trim(x)=''))=0) com,
  count(*) filter (len(f)=w and (kind<>'ratings' or (regexp_extract(f[1],'^([0-9]+)',1) in (select id from uid) and regexp_extract(f[2],'^([0-9]+)',1) in (select id from iid)))) con,
  count(*) filter (kind='ratings' and len(f)=4 and regexp_full_match(f[4],'[+-]?[0-9]+') and (case when try_cast(f[4] as bigint)>100000000000 then try_cast(f[4] as bigint)//1000 else try_cast(f[4] as bigint) end) between 788918400 and 1009843199) tim
  from (select kind, line, string_split(line,'::') f, case kind when 'ratings' then 4 when 'users' then 5 else 3 end w from {t})),
{n}y as (select acc*100.0::double/total a, com*100.0::double/total c, (total-(select coalesce(sum(n-1),0) from (select count(*) n from {t} group by kind, line)))*100.0::double/total u, con*100.0::double/total s, tim*100.0::double/nr t from {n}x),
{n} as (select floor(a*100+0.5)/100 accuracy, floor(c*100+0.5)/100 completeness, floor(u*100+0.5)/100 uniqueness, floor(s*100+0.5)/100 consistency, floor(t*100+0.5)/100 timeliness,
  floor((0.25*a+0.25*c+0.2*u+0.2*s+0.1*t)*100+0.5)/100 overall from {n}y)"""
_BEFORE, _AFTER = _SCORE.format(n="sb", t="raw", g=_GENRES), _SCORE.format(n="sa", t="kept", g=_GENRES)

_PREF = """, gc as (select user_id, item_id, value, unnest(genres) genre from tc join im using (item_id)),
gb as (select genre, round(sum(value)/count(*),6) baseline, count(*) n from gc group by 1),
gp as (select cluster, genre, round(m,3) avg_rating, round(m-baseline,3) delta from (select cluster, genre, sum(value)/count(*) m from gc join lb using (user_id) where cluster>=0 group by all) join gb using (genre)),
gt as (select *, row_number() over (partition by cluster order by delta desc, genre) place from gp)"""
_SPEC = """, spec as (select unnest([c_custkey::varchar, (c_custkey+9)||'-'||(c_custkey+5)]) p from customer),
asked as (select distinct unnest(range(least(a,z),greatest(a,z)+1)) user_id from (select string_split(p,'-')[1]::bigint a, string_split(p,'-')[-1]::bigint z from spec))"""
_MEMBERS = _SPEC + """, lo as (select user_id from st where user_count<5),
mem as (select user_id, case when cluster is not null then 'clustered' when user_id in (select user_id from us) then 'no_profile' else 'unknown' end status, cluster, cluster=-1 noise,
  case when cluster is not null then user_id in (select user_id from lo) end low_history, case when cluster is not null then user_id not in (select user_id from us) end no_demographics from asked left join lb using (user_id))"""
_VEC = """v as (select vec_id id, list_transform(embedding, lambda x: x::double) x from embeddings),
z as (select id, list_transform(x, lambda e: e/sqrt(list_dot_product(x,x))) x from v where list_dot_product(x,x)>0),
dist as (select a.id i, b.id j, greatest(1-list_dot_product(a.x,b.x),0) d from z a, z b),
kn as (select i id, d distance from (select i, d, row_number() over (partition by i order by d) k from dist where i<>j) where k=5)"""
_DB = "recursive " + _VEC + """, deg as (select i id, count(*) n from dist where d<=0.68 group by i), co as (select id from deg where n>=5),
ed as (select i, j from dist where d<=0.68 and i in (select id from co) and j in (select id from co)),
rc as (select id, id root from co union select e.j, rc.root from rc join ed e on e.i=rc.id),
ro as (select id, min(root) root from rc group by id), nu as (select root, row_number() over (order by root)-1 c from (select distinct root from ro)),
cl as (select id, c from ro join nu using (root)), bo as (select d.i id, min(c) c from dist d join cl on cl.id=d.j where d.d<=0.68 and d.i not in (select id from co) group by 1),
lab as (select v.id, coalesce(cl.c, bo.c, -1)::int cluster from v left join cl using (id) left join bo using (id))"""
_GRID = """, gr as (select 'class-'||period artifact_id, 'v1' version, round(avg(f2),6) metric from fe group by period)"""

_REP = "select item_id, cluster, n, avg_rating, title, place from (select *, row_number() over (partition by cluster order by avg_rating desc, n desc, item_id)::int place from (select cluster, item_id, count(*) n, round(sum(value)/count(*),6) avg_rating from tc join lb using (user_id) where cluster>=0 group by all) join im using (item_id) where n>=2 and avg_rating>=3) where place<=5"
_SIZE = "select * from (select cluster, count(*) size from lb where cluster>=0 group by 1) left join (select cluster, round(sum(value)/count(*),3) avg_rating from tc join lb using (user_id) where cluster>=0 group by 1) using (cluster)"
_DEMO = ", dm as (select * from lb join us using (user_id) where cluster>=0)"
_DEMOS = "select cluster, male_ratio, top_age, top_occupation from (select cluster, round(avg((gender='M')::int::double),3) male_ratio from dm group by 1) join (select cluster, age top_age from (select cluster, age, row_number() over (partition by cluster order by count(*) desc, age) k from dm group by cluster, age) where k=1) using (cluster) join (select cluster, occupation top_occupation from (select cluster, occupation, row_number() over (partition by cluster order by count(*) desc, occupation) k from dm group by cluster, occupation) where k=1) using (cluster)"
_SILHOUETTE = """, lc as (select id, id%3 c from z), ms as (select d.i, a.c own, b.c other, sum(d.d) t from dist d join lc a on a.id=d.i join lc b on b.id=d.j where d.i<>d.j group by all),
nn as (select c, count(*) n from lc group by 1), ab as (select i, max(case when own=other then t/(n-1) end) a, min(case when own<>other then t/n end) b from ms join nn on nn.c=other group by i)"""
_DB_SILHOUETTE = """, lc as (select id, cluster c from lab where cluster>=0), nn as (select c, count(*) n from lc group by 1),
ms as (select d.i, a.c own, b.c other, sum(d.d) filter (d.i<>d.j) t from dist d join lc a on a.id=d.i join lc b on b.id=d.j group by all),
ab as (select i, own c, max(n) filter (own=other) n, max(t/nullif(n-1,0)) filter (own=other) a, min(t/n) filter (own<>other) b from ms join nn on nn.c=other group by i, own)"""


def _q(ctes: str, body: str) -> str:
    return f"with {ctes.strip()}\n{body}"


ORACLES: dict[str, str] = {
    "score_before": _q(_RAW + _BEFORE, "select * from sb"),
    "score_after": _q(_TAGGED + _AFTER, "select * from sa"),
    "score_compare": _q(_TAGGED + _BEFORE + _AFTER, "select dimension, before, after, round(after-before,2) delta from (unpivot sb on accuracy,completeness,uniqueness,consistency,timeliness,overall into name dimension value before) join (unpivot sa on accuracy,completeness,uniqueness,consistency,timeliness,overall into name dimension value after) using (dimension)"),
    "clean_ratings": _q(_TAGGED, "select line from kept where kind='ratings'"),
    "clean_users": _q(_TAGGED, "select line from kept where kind='users'"),
    "clean_items": _q(_TAGGED, "select line from kept where kind='movies'"),
    "clean_summary": _q(_TAGGED, "select raw, kept, fixed, dedup, quarantine, conflict, quarantine+conflict quarantine_total, raw=kept+dedup+quarantine+conflict balanced from (select count(*) raw, count(*) filter (reason is null and cleaned<>line) fixed, count(reason) quarantine from tg), (select count(*) filter (not clash) kept, coalesce(sum(copies-1) filter (not clash),0)::bigint dedup, coalesce(sum(copies) filter (clash),0)::bigint conflict from gk)"),
    "quarantine_by_reason": _q(_TAGGED, "select kind, reason, count(*) n from qr group by all"),
    "quarantine_rows": _q(_TAGGED, "select * from qr"),
    "quarantine_samples": _q(_TAGGED, "select * from (select *, row_number() over (partition by kind, reason order by line)::int place from (select distinct * from qr)) where place<=3"),
    "clean_counts": _q(_TAGGED, "select kind, count(*) n from kept group by 1 union all select 'total', count(*) from kept"),
    "clean_samples": _q(_TAGGED, "select * from (select *, row_number() over (partition by kind order by line)::int place from (select distinct kind, line from kept)) where place<=3"),
    "bad_decoding": _q(_RAW, "select kind, count(*) lines, sum(contains(line,'�')::int)::bigint bad_lines from raw group by 1"),
    "reference_ids": _q(_RAW, "select id, 'users' kind from uid union all select id, 'movies' from iid"),
    "referential_check": _q(_RAW, "select line from r4 where m not in (select id from iid)"),
    "rule_truth": _q(_RAW + _BEFORE.split("count(*) filter (len(f)=w and (kind")[0].replace("select 'k' k, count(*) total, count(*) filter (kind='ratings') nr,", "select kind, case len(f) when 4 then 'ratings' when 5 then 'users' when 3 then 'movies' else 'unknown' end guess, count(*) n,").rstrip().rstrip(",") + ", count(*) filter (regexp_matches(line,'^[0-9]')) with_id, count(*) filter (not contains(line,'::') and (contains(line,',') or contains(line,'|') or contains(line,':'))) separated from rf group by all)", "select kind, guess, n, acc valid, com filled, with_id, separated from sbx"),
    "field_count_histogram": _q(_RAW, "select kind, len(f)::int fields, count(*) n from rf group by all"),
    "non_integer_counts": _q(_RAW, "select " + ", ".join(f"count(*) filter (not regexp_full_match({c},'[+-]?[0-9]+')) {n}" for c, n in (("u", "user_bad"), ("m", "item_bad"), ("r", "rating_bad"), ("t", "ts_bad"))) + " from r4"),
    "rating_range_report": _q(_RAW, "select count(*) filter (lr not between 1 and 5) out_of_range, count(*) filter (lr is null) not_int from r4"),
    "ts_report": _q(_RAW, "select *, strftime(to_timestamp(min_ts) at time zone 'UTC','%Y-%m-%d') min_day, strftime(to_timestamp(max_ts) at time zone 'UTC','%Y-%m-%d') max_day from (select min(lt) filter (lt>0 and lt<2000000000) min_ts, max(lt) filter (lt>0 and lt<2000000000) max_ts, count(*) filter (lt>0 and lt<2000000000) valid, count(*) filter (not coalesce(lt>0 and lt<2000000000,false)) invalid from r4)"),
    "exact_duplicates": _q(_RAW, "select sum(n-1)::bigint repeats from (select count(*) n from r4 group by u,m,r,t)"),
    "key_conflicts": _q(_RAW, "select 'rating_by_key' probe, count(*) filter (c>1) keys from (select count(distinct r) c from r4 group by u,m,t) union all select 'user_attributes', count(*) filter (c>1) from (select count(distinct f[2:5]) c from rf where kind='users' and len(f)=5 group by f[1]) union all select 'item_attributes', count(*) filter (c>1) from (select count(distinct f[2:3]) c from rf where kind='movies' and len(f)=3 group by f[1]) union all select 'title_ids', count(*) filter (c>1) from (select count(distinct f[1]) c from rf where kind='movies' and len(f)=3 group by f[2])"),
    "distinct_counts": _q(_RAW, "select count(distinct u) users, count(distinct m) items from r4"),
    "value_distribution": _q(_RAW, "select attribute, value, legal, count(*) n from (select 'gender' attribute, f[2] as value, f[2] in ('F','M') legal from rf where kind='users' and len(f)=5 union all select 'age', f[3], f[3] in ('1','18','25','35','45','50','56') from rf where kind='users' and len(f)=5 union all select 'occupation', f[4], coalesce(try_cast(f[4] as int),-1) between 0 and 20 from rf where kind='users' and len(f)=5) group by all"),
    "zip_report": _q(_RAW, "select count(*) filter (regexp_full_match(f[5],'[0-9]+')) digits, count(*) filter (length(f[5])<5) short, count(*) filter (starts_with(f[5],'0')) leading_zero, count(*) filter (not regexp_full_match(f[5],'[0-9]+')) not_digits from rf where kind='users' and len(f)=5"),
    "title_report": _q(_RAW, "select count(*) filter (trim(f[2])='') blank, count(*) filter (y is null) no_year, count(*) filter (y not between 1880 and 2010) bad_year, count(*) filter (trim(f[3])='') no_genre from (select f, nullif(regexp_extract(f[2],'\\(([0-9]{4})\\)\\s*$',1),'')::int y from rf where kind='movies' and len(f)=3)"),
    "genre_histogram": _q(_RAW, "select genre, count(*) n from (select trim(unnest(string_split(f[3],'|'))) genre from rf where kind='movies' and len(f)=3) where genre<>'' group by 1 order by n desc, genre limit 30"),
    "orphan_counts": _q(_RAW, "select count(*) filter (u not in (select f[1] from rf where kind='users' and len(f)=5)) unknown_user, count(*) filter (m not in (select f[1] from rf where kind='movies' and len(f)=3)) unknown_item from r4"),
    "monthly_histogram": _q(_RAW, "select strftime(to_timestamp(lt) at time zone 'UTC','%Y-%m') as month, count(*) n from r4 where lr between 1 and 5 and lt between 788918400 and 1009843199 group by 1"),
    "order_statistics": _q(_RAW, "select share, ts from (select lt ts, row_number() over (order by lt)-1 k, count(*) over () n from r4 where lr between 1 and 5 and lt between 788918400 and 1009843199) join (select unnest([0.0::double,0.25,0.5,0.9,0.99]) share) on k=least(floor(n*share)::bigint,n-1)"),
    "dirty_samples": _q(_RAW, "select kind, defect, place, line from (select *, row_number() over (partition by kind, defect order by line)::int place from (select kind, line, unnest(list_filter([case when len(f)<>w then 'width' end, case when kind='ratings' and len(f)=w and try_cast(f[4] as bigint)>2000000000 then 'late_ts' end, case when kind='ratings' and len(f)=w and not coalesce(try_cast(f[3] as bigint) between 1 and 5,false) then 'rating' end, case when kind='users' and len(f)=w and f[2] not in ('F','M') then 'gender' end, case when kind='users' and len(f)=w and f[3] not in ('1','18','25','35','45','50','56') then 'age' end, case when kind='users' and len(f)=w and coalesce(try_cast(f[4] as int),-1) not between 0 and 20 then 'occupation' end, case when kind='movies' and len(f)=w and not coalesce(nullif(regexp_extract(f[2],'\\(([0-9]{4})\\)',1),'')::int between 1880 and 2010,false) then 'year' end, case when kind='movies' and len(f)=w and (trim(f[3])='' or not list_has_all(" + _GENRES + ", string_split(regexp_replace(f[3],'[|]+$',''),'|'))) then 'genre' end], lambda x: x is not null)) defect from rf)) where place<=3"),
    "typed_failures": _q(_RAW, "select kind, reason, n from (" + " union all ".join([
        "select kind, unnest(['lines','failed','no_user_id','no_item_id','no_rating','no_ts']) reason, unnest([count(*), count(*) filter (u is null or i is null or r is null or t is null), count(*) filter (u is null), count(*) filter (i is null), count(*) filter (r is null), count(*) filter (t is null)]) n from (select kind, try_cast(f[1] as bigint) u, try_cast(f[2] as bigint) i, try_cast(f[3] as int) r, try_cast(f[4] as bigint) t from rf where kind='ratings') group by kind",
        "select kind, unnest(['lines','failed','no_user_id','no_gender','no_age','no_occupation','no_zip']), unnest([count(*), count(*) filter (u is null or g is null or a is null or o is null or z is null), count(*) filter (u is null), count(*) filter (g is null), count(*) filter (a is null), count(*) filter (o is null), count(*) filter (z is null)]) from (select kind, try_cast(f[1] as bigint) u, f[2] g, try_cast(f[3] as int) a, try_cast(f[4] as int) o, f[5] z from rf where kind='users') group by kind",
        "select kind, unnest(['lines','failed','no_item_id','no_title','no_genres']), unnest([count(*), count(*) filter (i is null or t is null or g is null), count(*) filter (i is null), count(*) filter (t is null), count(*) filter (g is null)]) from (select kind, try_cast(f[1] as bigint) i, f[2] t, f[3] g from rf where kind='movies') group by kind"]) + ")"),
    "profile_export": _q(_TYPED, "select 'cells_' || period name, count(distinct (user_id, item_id)) n from iv group by period union all select 'user_vocabulary', count(*) from tu union all select 'item_vocabulary', count(*) from ti union all select 'users', count(*) from us union all select 'items', count(*) from im union all select 'user_stats', count(*) from tu union all select 'item_stats', count(*) from ti union all select 'global_mean', 1 union all select 'low_history', count(*) from (select user_id from sp where period='train' group by user_id having count(*) < 5) union all select 'new_items', count(distinct period) from sp where period<>'train' union all select 'meta', count(distinct period) from sp"),
    "time_split": _q(_TYPED, "select period, rating, count(*) n from sp group by all"),
    "vocabulary": _q(_TYPED, "select user_id id, row_number() over (order by user_id)-1 idx from tu"),
    "raw_files": _q(_RAW, "select kind, count(*) lines, sum(regexp_matches(line,'[ae]')::int)::bigint accented, sum(length(line))::bigint characters from raw group by 1"),
    "user_activity": _q(_TYPED, "select user_id, count(*) items, sum(value)::bigint total, any_value(user_mean) user_mean, any_value(user_count) user_count from tc join st using (user_id) group by 1"),
    "user_item_cells": _q(_TYPED, "select * from ce"),
    "user_stats": _q(_TYPED, "select * from st"),
    "item_stats": _q(_TYPED, "select * from ic cross join gm"),
    "low_history": _q(_TYPED, "select user_id, user_count from st where user_count<5"),
    "new_items": _q(_TYPED, "select period, count(*) filter (item_id not in (select item_id from ti)) new_items from (select distinct period, item_id from sp where period<>'train') group by 1"),
    "profile_meta": _q(_TYPED, "select period, count(*) events, round(avg((rating>=4)::int::double),6) positive_ratio, count(*) filter (user_id in (select user_id from tu) and item_id in (select item_id from ti)) kept_events from sp group by 1"),
    "attribute_tables": _q(_TYPED, "select item_id, title, array_to_string(genres,'|') genres from im"),
    "event_features": _q(_FEATURES, "select user_id, item_id, ts, period, label, round(f1,6) f1, round(f2,6) f2, array_to_string(flags,'') genres, age_code::int age_code, gender, occupation from fe"),
    "cold_start_counts": _q(_FEATURES, "select period, count(*) filter (cold_user) cold_user, count(*) filter (cold_item) cold_item, count(*) filter (no_demographics) no_demographics from fe group by 1"),
    "standardize": _q(_FEATURES, "select period, round(avg((f1-m1)/s1),5)+0.0 avg_z1, round(avg((f2-m2)/s2),5)+0.0 avg_z2, round(stddev_pop((f1-m1)/s1),5) dev_z1, round(stddev_pop((f2-m2)/s2),5) dev_z2 from fe, (select avg(f1) m1, stddev_pop(f1) s1, avg(f2) m2, stddev_pop(f2) s2 from fe where period='train') group by 1"),
    "average_precision": _q(_FEATURES, "select round(sum(pos*cp/ck)/sum(pos),6) average_precision from (select pos, sum(pos) over (order by score desc) cp, sum(n) over (order by score desc) ck from (select score, sum(label) pos, count(*) n from sc where period='val' group by 1))"),
    "threshold_metrics": _q(_FEATURES, "select *, round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0),4) f1, round((tn+tp)/n,4) accuracy, round((fn+tp)/n,4) positive_ratio from (select count(*) filter (label=0 and score<0.5) tn, count(*) filter (label=0 and score>=0.5) fp, count(*) filter (label=1 and score<0.5) fn, count(*) filter (label=1 and score>=0.5) tp, count(*) n from sc where period='test')"),
    "predict_status": _q(_TYPED, "select user_id, item_id, status, case when status='ok' then concat_ws(',', case when not ut then 'user_no_history' end, case when not it then 'item_cold' end, case when not ia then 'item_no_attributes' end, case when not ua then 'user_no_demographics' end) else '' end notes from (select *, case when not ut and not ua then 'unknown_user' when not it and not ia then 'unknown_item' else 'ok' end status from (select user_id, item_id, user_id in (select user_id from tu) ut, user_id in (select user_id from us) ua, item_id in (select item_id from ti) it, item_id in (select item_id from im) ia from (select distinct case when l_orderkey%7=0 then o_custkey+10000000 else o_custkey end user_id, case when l_orderkey%7=1 then l_partkey+10000000 else l_partkey end item_id from lineitem join orders on l_orderkey=o_orderkey)))"),
    "l2_normalize": _q(_TYPED, "select user_id, item_id, round(value/sqrt(sum(value*value) over (partition by user_id)),6) as value from tc"),
    "knn_distance": _q(_VEC, "select id, round(distance,6) distance from kn"),
    "eps_candidates": _q(_VEC, "select unnest([50,70,90])::int percent, unnest([round(quantile_cont(distance,0.5),4),round(quantile_cont(distance,0.7),4),round(quantile_cont(distance,0.9),4)]) eps from kn"),
    "dbscan_labels": _q(_DB, "select * from lab"),
    "dbscan_metrics": _q(_DB + _DB_SILHOUETTE, "select * from (select count(distinct cluster) filter (cluster>=0) clusters, round(avg((cluster=-1)::int::double),4) noise from lab join z using (id)), (select coalesce(list(n order by c), []::bigint[]) sizes from nn), (select round(case when count(distinct c)>1 then avg(case when n=1 then 0 else coalesce((b-a)/nullif(greatest(a,b),0),0) end) end,6) silhouette from ab)"),
    "genre_baseline": _q(_TYPED + _PREF, "select * from gb"),
    "cluster_size_rating": _q(_TYPED, _SIZE),
    "cluster_genre_pref": _q(_TYPED + _PREF, "select cluster, genre, avg_rating, delta, place::int place from gt where place<=5"),
    "cluster_rep_items": _q(_TYPED, _REP),
    "cluster_demographics": _q(_TYPED + _DEMO, _DEMOS),
    "expand_user_spec": _q(_RAW + _SPEC, "select user_id from asked"),
    "membership": _q(_TYPED + _MEMBERS, "select * from mem"),
    "touched_groups": _q(_TYPED + _MEMBERS + _PREF, "select cluster, 'genre' kind, place::int place, genre as name, avg_rating, delta from gt where place<=3 and cluster in (select cluster from mem) union all select cluster, 'item', place, title, avg_rating, null from (" + _REP + ") where place<=3 and cluster in (select cluster from mem)"),
    "top_loading_items": _q(_TYPED, "select component, place, item_id, title, round(loading,4) loading from (select *, row_number() over (partition by component order by abs(loading) desc, item_id)::int place from (select (item_id%3)::int component, item_id, round(avg(value)-3,6) loading from tc group by all) join im using (item_id)) where place<=8"),
    "grid_upsert": _q(_FEATURES + _GRID, "select artifact_id, case artifact_id when 'class-val' then 'v2' else version end version, metric from gr"),
    "overview": _q(_FEATURES, "select *, row_number() over (partition by task, algorithm order by metric desc, position)=1 selected from (select (['class','cluster','reduce'])[user_id%3+1] task, (['first','second'])[item_id%2+1] algorithm, period as position, round(avg(rating),6) metric from fe group by all)"),
    "select_best": _q(_FEATURES, "select (user_id%8)::int as position, round(avg(label),6) val_ap from fe group by 1 order by val_ap desc, position limit 1"),
    "select_kmeans": _q(_FEATURES, "select (user_id%4)::int+5 k, round(avg(label),6) silhouette, count(*) sse from fe group by 1 order by silhouette desc, k limit 1"),
    "select_dbscan": _q(_FEATURES, "select * from (select (user_id%12)::int as position, count(*)%20 clusters, round(avg(label),6) noise, round(avg(rating)-3,6) silhouette from fe group by 1) order by (clusters between 2 and 15 and noise<0.5) desc, silhouette desc, position limit 1"),
    "reduction_report": _q(_FEATURES, "select 'pca' algorithm, dim, evr, error, case when evr is null then 'not_registered' else 'ok' end status from (select unnest([10,12])::int dim) left join (select ([2,10,20,50])[item_id%4+1]::int dim, round(avg(label),4) evr, round(avg(rating),4) error from fe where user_id%2=0 group by 1) using (dim)"),
    "cosine_silhouette": _q(_VEC + _SILHOUETTE, "select round(avg((b-a)/greatest(a,b)),6) silhouette from ab"),
    "cluster_sizes": _q(_TYPED, "select k::int cluster, count(cluster) n from (select unnest(range(6)) k) left join lb on cluster=k group by 1"),
    "dbscan_sizes": _q(_DB, "select cluster, count(*) n from lab group by 1"),
    "cluster_summaries": _q(_TYPED + _PREF + _DEMO, "select cluster, size, avg_rating, genres, items, male_ratio, top_age, top_occupation from (" + _SIZE + ") left join (select cluster, string_agg(place||':'||genre, ',' order by place) genres from gt where place<=5 group by 1) using (cluster) left join (select cluster, string_agg(place||':'||item_id, ',' order by place) items from (" + _REP + ") group by 1) using (cluster) left join (" + _DEMOS + ") using (cluster)"),
}
