"""Queries of the catalog: listings, access and changes.

Listings run for all users at once unless the question itself is about one user and everything
that user does not have.
"""

from pyspark.sql import functions as F

from ..operators import access, catalog as c, gallery, lifecycle, reasons
from ..operators.joins import among
from ..session import scratch_path
from .tables import CATALOG, catalog, read

UID = 7


def _at(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


AT = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
UPLOADED, CREATED = AT.format("uploaded_at"), AT.format("created_at")


def _with(body):
    return f"with {CATALOG} {body}"


# --- listings ---------------------------------------------------------------------------------


def own_datasets(spark, folder):
    return c.datasets_owned(catalog(spark, folder)).select("viewer_id", "id", "original_filename", _at("uploaded_at"))


OWN_DATASETS = _with(f"select user_id as viewer_id, id, original_filename, {UPLOADED} as uploaded_at from datasets")


def received_datasets(spark, folder):
    return c.datasets_shared_with(catalog(spark, folder)).select("viewer_id", "id", "original_filename", "owner", _at("uploaded_at"))


RECEIVED_DATASETS = _with(f"""
select distinct target_id as viewer_id, d.id, original_filename, coalesce(u.name, 'Unknown') as owner, {UPLOADED} as uploaded_at
from shares s join datasets d on s.object_id = d.id left join users u on u.id = d.user_id where object_type = 'dataset'""")


def public_datasets(spark, folder):
    return c.datasets_public(catalog(spark, folder), UID).select("id", "user_id", "original_filename", _at("uploaded_at"))


PUBLIC_DATASETS = _with(f"""
select id, user_id, original_filename, {UPLOADED} as uploaded_at from datasets
where is_public and user_id <> {UID}
  and id not in (select object_id from shares where target_id = {UID} and object_type = 'dataset')""")


def receivers(spark, folder):
    return c.shared_with(catalog(spark, folder), c.DATASET).select("owner_id", "object_id", "target_id", "name")


RECEIVERS = _with("""
select distinct owner_id, object_id, target_id, name from shares join users u on u.id = target_id where object_type = 'dataset'""")


def others(spark, folder):
    return c.other_users(catalog(spark, folder), UID)


OTHERS = _with(f"select id, name from users where id <> {UID}")


def _busiest(spark, folder):
    """Owner and dashboard with the most share rows."""
    shares = catalog(spark, folder).shares.where("object_type = 'visualisation'")
    counted = shares.groupBy("owner_id", "object_id").count()
    return counted.orderBy(F.desc("count"), "object_id").first()


def possible_receivers(spark, folder):
    owner, dashboard, _ = _busiest(spark, folder)
    return c.shareable_users(catalog(spark, folder), owner, dashboard)


POSSIBLE_RECEIVERS = _with("""
, b as (select owner_id, object_id from shares where object_type = 'visualisation' group by all order by count(*) desc, object_id limit 1)
select id, name, email from users, b where id <> b.owner_id and id not in (
    select s.target_id from shares s join b on s.owner_id = b.owner_id and s.object_id = b.object_id and s.object_type = 'visualisation')""")


def own_dashboards(spark, folder):
    return c.visualisations_owned(catalog(spark, folder)).select("viewer_id", "id", "title", "dataset_name", _at("created_at"))


OWN_DASHBOARDS = _with(f"""
select d.user_id as viewer_id, v.id, title, original_filename as dataset_name, {CREATED} as created_at
from visualisations v join datasets d on d.id = v.dataset_id""")


def _hot_owner(cat):
    """The owner of the dataset that has a third of all dashboards."""
    return cat.datasets.where("id = 0").first()["user_id"]


def gallery_page(spark, folder):
    """The third page of one user's dashboards."""
    cat = catalog(spark, folder)
    mine = c.visualisations_owned(cat, _hot_owner(cat)).select("id", "title", "created_at")
    return c.page(mine, [F.desc("created_at"), F.desc("id")], 3).withColumn("created_at", _at("created_at"))


GALLERY_PAGE = _with(f"""
select v.id, title, {AT.format('v.created_at')} as created_at from visualisations v join datasets d on d.id = v.dataset_id
where user_id = (select user_id from datasets where id = 0) order by v.created_at desc, v.id desc limit 6 offset 12""")


def gallery_next_page(spark, folder):
    """The page after the twelve newest dashboards, by the last row shown instead of its number."""
    cat = catalog(spark, folder)
    mine = c.visualisations_owned(cat, _hot_owner(cat)).select("id", "title", "created_at")
    first = c.page_after(mine, per_page=12).collect()
    after = c.page_after(mine, (first[-1]["created_at"], first[-1]["id"]))
    return after.withColumn("created_at", _at("created_at"))


GALLERY_NEXT_PAGE = GALLERY_PAGE


def gallery_deep_page(spark, folder):
    """The middle page of the largest gallery, of stored galleries of all users."""
    cat = catalog(spark, folder)
    mine = c.visualisations_owned(cat).select("viewer_id", "id", "title", "created_at")
    stored = gallery.write_gallery(mine, scratch_path(spark, "gallery"))
    owner = _hot_owner(cat)
    middle = (gallery.gallery_total(stored, owner) + c.PAGE_SIZE - 1) // c.PAGE_SIZE // 2
    shown = gallery.gallery_page_at(stored, owner, middle)
    return shown.select("id", "title", _at("created_at"))


GALLERY_DEEP_PAGE = _with(f"""
, m as (select v.id, title, v.created_at, row_number() over (order by v.created_at desc, v.id desc) as place, count(*) over () as total
        from visualisations v join datasets d on d.id = v.dataset_id where user_id = (select user_id from datasets where id = 0))
select id, title, {CREATED} as created_at from m where (place - 1) // 6 = greatest((total + 5) // 6 // 2, 1) - 1""")


def gallery_size(spark, folder):
    cat = catalog(spark, folder)
    return c.page_info(c.visualisations_owned(cat), 3)


GALLERY_SIZE = _with("""
select 3 as page, count(*) as total, cast(ceil(count(*) / 6.0) as bigint) as pages, true as has_prev, ceil(count(*) / 6.0) > 3 as has_next
from visualisations v join datasets d on d.id = v.dataset_id""")


def received_dashboards(spark, folder):
    return c.visualisations_shared_with(catalog(spark, folder)).select("viewer_id", "id", "title", "dataset_name", "owner", _at("created_at"))


RECEIVED_DASHBOARDS = _with(f"""
select target_id as viewer_id, v.id, title, original_filename as dataset_name, u.name as owner, {AT.format('v.created_at')} as created_at
from shares s join visualisations v on s.object_id = v.id join datasets d on d.id = v.dataset_id join users u on u.id = d.user_id
where object_type = 'visualisation'""")


def dashboards_by_dataset(spark, folder):
    return c.dataset_visualisations(catalog(spark, folder)).select("dataset_id", "id", "title", _at("created_at"))


DASHBOARDS_BY_DATASET = _with(f"select dataset_id, id, title, {CREATED} as created_at from visualisations")


def counts_by_user(spark, folder):
    return c.user_counts(catalog(spark, folder))


COUNTS_BY_USER = _with("""
select u.id as user_id, count(distinct d.id) as n_datasets, count(v.id) as n_visualisations
from users u left join datasets d on d.user_id = u.id left join visualisations v on v.dataset_id = d.id group by u.id""")


def dataset_list(spark, folder):
    return c.listing(catalog(spark, folder).datasets)


DATASET_LIST = _with("""
select id, original_filename as filename, upper(file_type) as file_type, n_rows, n_columns,
       case when is_public then 'Public' else 'Private' end as visibility,
       strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S') as uploaded_at, strftime(uploaded_at, '%b %d, %Y') as day,
       strftime(uploaded_at, '%b %d, %Y %H:%M') as minute
from datasets""")

# --- access -----------------------------------------------------------------------------------


def dataset_rights(spark, folder):
    rights = access.dataset_access(catalog(spark, folder))
    return rights.withColumn("user_id", F.coalesce("user_id", F.lit(-1)))


def _rights(objects, object_type, id_name):
    return _with(f"""
, o as ({objects})
select user_id, object_id as {id_name}, 'owner' as reason, is_public from o
union all select -1, object_id, 'public', true from o where is_public
union all select distinct target_id, o.object_id, case when is_public then 'public' else 'shared' end, is_public
from shares s join o on o.object_id = s.object_id where s.object_type = '{object_type}' and target_id <> user_id""")


DATASET_OBJECTS = "select id as object_id, user_id, is_public from datasets"
DASHBOARD_OBJECTS = "select v.id as object_id, d.user_id, d.is_public from visualisations v join datasets d on d.id = v.dataset_id"
DATASET_RIGHTS = _rights(DATASET_OBJECTS, "dataset", "dataset_id")


def dashboard_rights(spark, folder):
    rights = access.visualisation_access(catalog(spark, folder))
    return rights.withColumn("user_id", F.coalesce("user_id", F.lit(-1)))


DASHBOARD_RIGHTS = _rights(DASHBOARD_OBJECTS, "visualisation", "visualisation_id")


def _requests(spark, folder):
    """Every supplier asks for the object of each of its line items and for the next one."""
    lines = read(spark, folder, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("object_id"))
    return lines.unionByName(lines.withColumn("object_id", F.col("object_id") + 1))


REQUESTS = "select l_suppkey as user_id, l_orderkey as object_id from lineitem union select l_suppkey, l_orderkey + 1 from lineitem"


def dataset_requests(spark, folder):
    checked = access.can_view_dataset(catalog(spark, folder), _requests(spark, folder))
    return checked.withColumn("reason", F.coalesce("reason", F.lit("")))


def _decided(objects, object_type):
    return _with(f"""
, o as ({objects}), r as ({REQUESTS}),
s as (select distinct target_id, object_id from shares where object_type = '{object_type}'),
j as (select r.user_id, r.object_id,
             case when o.user_id = r.user_id then 'owner' when o.is_public then 'public'
                  when s.target_id is not null and o.object_id is not null then 'shared' else '' end as reason
      from r left join o on o.object_id = r.object_id left join s on s.object_id = r.object_id and s.target_id = r.user_id)
select user_id, object_id, reason <> '' as allowed, reason from j""")


DATASET_REQUESTS = _decided(DATASET_OBJECTS, "dataset")


def dashboard_requests(spark, folder):
    checked = access.can_view_visualisation(catalog(spark, folder), _requests(spark, folder))
    return checked.withColumn("reason", F.coalesce("reason", F.lit("")))


DASHBOARD_REQUESTS = _decided(DASHBOARD_OBJECTS, "visualisation")

# --- changes ----------------------------------------------------------------------------------


def granted_shares(spark, folder):
    """Each owner of an order shares it with the supplier keys 0 and 1, some of which have it already."""
    cat = catalog(spark, folder)
    both = F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")))
    new = cat.datasets.select(F.col("user_id").alias("owner_id"), F.lit("dataset").alias("object_type"), F.col("id").alias("object_id")).withColumn("target_id", both)
    after = lifecycle.grant(cat.shares, new.unionByName(new))
    return after.groupBy("owner_id", "target_id", "object_type", "object_id").agg(F.count("*").alias("n"))


GRANTED_SHARES = _with("""
, new as (select user_id as owner_id, t as target_id, 'dataset' as object_type, id as object_id from datasets, (values (0), (1)) x(t)),
a as (select owner_id, target_id, object_type, object_id from shares
      union all select * from new where not exists (select 1 from shares s where s.owner_id = new.owner_id and s.target_id = new.target_id
                and s.object_type = new.object_type and s.object_id = new.object_id))
select owner_id, target_id, object_type, object_id, count(*) as n from a group by all""")


def revoked_shares(spark, folder):
    """Shares of urgent orders are taken back."""
    cat = catalog(spark, folder)
    urgent = read(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("object_id"))
    gone = cat.shares.join(urgent, "object_id", "left_semi")
    after = lifecycle.revoke(cat.shares, gone)
    return after.groupBy("object_type", "owner_id").agg(F.count("*").alias("n"), F.sum("object_id").alias("ids"))


REVOKED_SHARES = _with("""
select object_type, owner_id, count(*) as n, cast(sum(object_id) as bigint) as ids from shares
where object_id not in (select o_orderkey from orders where o_orderpriority = '1-URGENT') group by object_type, owner_id""")


def _left(cat):
    """What is left of each table: its ids, shares by the object they point to."""
    users = cat.users.select(F.lit("user").alias("kind"), "id", F.lit(1).cast("bigint").alias("n"))
    datasets = cat.datasets.select(F.lit("dataset").alias("kind"), "id", F.lit(1).cast("bigint").alias("n"))
    boards = cat.visualisations.select(F.lit("visualisation").alias("kind"), "id", F.lit(1).cast("bigint").alias("n"))
    shares = cat.shares.groupBy(F.concat(F.lit("share of "), "object_type").alias("kind"), F.col("object_id").alias("id")).agg(F.count("*").alias("n"))
    return users.unionByName(datasets).unionByName(boards).unionByName(shares)


def _left_sql(users="true", datasets="true", boards="true", shares="true"):
    return f"""
select 'user' as kind, id, 1 as n from users where {users}
union all select 'dataset', id, 1 from datasets where {datasets}
union all select 'visualisation', id, 1 from visualisations where {boards}
union all select 'share of ' || object_type, object_id, count(*) from shares where {shares} group by all"""


def without_error_dashboards(spark, folder):
    cat = catalog(spark, folder)
    errors = cat.visualisations.where(F.startswith(F.col("title"), F.lit("error")))
    return _left(lifecycle.delete_visualisations(cat, errors))


_ERRORS = "(select id from visualisations where title like 'error%')"
WITHOUT_ERROR_DASHBOARDS = _with(_left_sql(
    boards=f"id not in {_ERRORS}", shares=f"not (object_type = 'visualisation' and object_id in {_ERRORS})"
))


def without_csv_datasets(spark, folder):
    cat = catalog(spark, folder)
    return _left(lifecycle.delete_datasets(cat, cat.datasets.where("file_type = 'csv'")))


_CSV = "(select id from datasets where file_type = 'csv')"
WITHOUT_CSV_DATASETS = _with(_left_sql(datasets=f"id not in {_CSV}", boards=f"dataset_id not in {_CSV}"))


def without_debtors(spark, folder):
    """Accounts with a negative balance are deleted."""
    cat = catalog(spark, folder)
    debtors = read(spark, folder, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return _left(lifecycle.delete_users(cat, debtors))


_DEBTORS = "(select c_custkey from customer where c_acctbal < 0)"
_THEIRS = f"(select id from datasets where user_id in {_DEBTORS})"
WITHOUT_DEBTORS = _with(_left_sql(
    users=f"id not in {_DEBTORS}", datasets=f"user_id not in {_DEBTORS}", boards=f"dataset_id not in {_THEIRS}",
    shares=f"owner_id not in {_DEBTORS} and target_id not in {_DEBTORS}",
))


def flipped_datasets(spark, folder):
    cat = catalog(spark, folder)
    large = read(spark, folder, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("id"))
    return lifecycle.toggle_public(cat.datasets, large).select("id", "is_public")


FLIPPED_DATASETS = _with("""
select id, is_public <> (id in (select o_orderkey from orders where o_totalprice > 200000)) as is_public from datasets""")


def integrity(spark, folder):
    """Report after the csv datasets are gone: their shares are orphans."""
    cat = catalog(spark, folder)
    left = lifecycle.delete_datasets(cat, cat.datasets.where("file_type = 'csv'"))
    report = lifecycle.integrity_report(left)
    return report.withColumns({"object_id": F.coalesce("object_id", F.lit(-1)), "detail": F.coalesce("detail", F.lit(""))})


INTEGRITY = _with(f"""
, d as (select id from datasets where file_type <> 'csv'), v as (select id from visualisations where dataset_id not in {_CSV})
select 'orphaned share' as issue, object_type, object_id, '' as detail, count(*) as n from shares
where not ((object_type = 'dataset' and object_id in (select id from d)) or (object_type = 'visualisation' and object_id in (select id from v)))
group by all
union all select 'repeated share', object_type, object_id, owner_id || '->' || target_id, count(*) from shares
group by object_type, object_id, owner_id, target_id having count(*) > 1
union all select 'repeated e-mail', 'user', -1, email, count(*) from users group by email having count(*) > 1""")


def rights_after_changes(spark, folder):
    """Rights over datasets and dashboards, kept up to date through one change of each kind; the catalog is read for the first batch only."""
    cat = catalog(spark, folder)
    path = scratch_path(spark, "reasons")
    orders = read(spark, folder, "orders")
    third = cat.datasets.where("id % 3 = 0").select(F.col("user_id").alias("owner_id"), F.lit("dataset").alias("object_type"), F.col("id").alias("object_id"))
    new = third.withColumn("target_id", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    changes = [
        lambda now: reasons.all_reasons(cat),
        lambda now: reasons.granted(now, new.unionByName(new)),
        lambda now: reasons.revoked(now, among(reasons.granted_before(spark, path, 1), "object_id", urgent)),
        lambda now: reasons.flipped(now, orders.where("o_totalprice > 200000").select(F.col("o_orderkey").alias("id"))),
        lambda now: reasons.without_visualisations(now, cat.visualisations.where(F.startswith(F.col("title"), F.lit("error"))).select("id")),
        lambda now: reasons.without_datasets(now, cat.datasets.where("id % 7 = 3").select("id")),
        lambda now: reasons.without_users(now, read(spark, folder, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))),
    ]
    for batch, change in enumerate(changes):
        reasons.add_batch(change(reasons.read_batches(spark, path, batch) if batch else None), path, batch)
    now = reasons.read_reasons(spark, path)
    both = [reasons.rights(now, kind).withColumn("object_type", F.lit(kind)) for kind in (c.DATASET, c.VISUALISATION)]
    return both[0].unionByName(both[1]).withColumn("user_id", F.coalesce("user_id", F.lit(-1)))


RIGHTS_AFTER_CHANGES = _with(f"""
, new as (select user_id as owner_id, t as target_id, 'dataset' as object_type, id as object_id from datasets, (values (0), (1)) x(t) where id % 3 = 0),
s1 as (select owner_id, target_id, object_type, object_id from shares
       union all select * from new where not exists (select 1 from shares s where s.owner_id = new.owner_id and s.target_id = new.target_id
                 and s.object_type = new.object_type and s.object_id = new.object_id)),
u as (select o_orderkey as id from orders where o_orderpriority = '1-URGENT'),
s2 as (select s1.* from s1 where not exists (
           select 1 from shares s where s.object_id in (select id from u) and s.owner_id = s1.owner_id and s.target_id = s1.target_id
           and s.object_type = s1.object_type and s.object_id = s1.object_id)
       and target_id not in {_DEBTORS} and owner_id not in {_DEBTORS} and not (object_type = 'visualisation' and object_id in {_ERRORS})),
d2 as (select id, user_id, is_public <> (id in (select o_orderkey from orders where o_totalprice > 200000)) as is_public from datasets
       where id % 7 <> 3 and user_id not in {_DEBTORS}),
o as (select 'dataset' as object_type, id as object_id, user_id, is_public from d2
      union all select 'visualisation', v.id, d2.user_id, d2.is_public from visualisations v join d2 on d2.id = v.dataset_id where v.id not in {_ERRORS})
select object_type, user_id, object_id, 'owner' as reason, is_public from o
union all select object_type, -1, object_id, 'public', true from o where is_public
union all select distinct o.object_type, target_id, o.object_id, case when is_public then 'public' else 'shared' end, is_public
from s2 join o on o.object_id = s2.object_id and o.object_type = s2.object_type where target_id <> user_id""")


QUERIES = {
    "own_datasets": own_datasets,
    "received_datasets": received_datasets,
    "public_datasets": public_datasets,
    "receivers": receivers,
    "other_users": others,
    "possible_receivers": possible_receivers,
    "own_dashboards": own_dashboards,
    "gallery_page": gallery_page,
    "gallery_next_page": gallery_next_page,
    "gallery_deep_page": gallery_deep_page,
    "gallery_size": gallery_size,
    "received_dashboards": received_dashboards,
    "dashboards_by_dataset": dashboards_by_dataset,
    "counts_by_user": counts_by_user,
    "dataset_list": dataset_list,
    "dataset_rights": dataset_rights,
    "dashboard_rights": dashboard_rights,
    "dataset_requests": dataset_requests,
    "dashboard_requests": dashboard_requests,
    "granted_shares": granted_shares,
    "revoked_shares": revoked_shares,
    "without_error_dashboards": without_error_dashboards,
    "without_csv_datasets": without_csv_datasets,
    "without_debtors": without_debtors,
    "flipped_datasets": flipped_datasets,
    "integrity": integrity,
    "rights_after_changes": rights_after_changes,
}

SQL = {
    "own_datasets": OWN_DATASETS,
    "received_datasets": RECEIVED_DATASETS,
    "public_datasets": PUBLIC_DATASETS,
    "receivers": RECEIVERS,
    "other_users": OTHERS,
    "possible_receivers": POSSIBLE_RECEIVERS,
    "own_dashboards": OWN_DASHBOARDS,
    "gallery_page": GALLERY_PAGE,
    "gallery_next_page": GALLERY_NEXT_PAGE,
    "gallery_deep_page": GALLERY_DEEP_PAGE,
    "gallery_size": GALLERY_SIZE,
    "received_dashboards": RECEIVED_DASHBOARDS,
    "dashboards_by_dataset": DASHBOARDS_BY_DATASET,
    "counts_by_user": COUNTS_BY_USER,
    "dataset_list": DATASET_LIST,
    "dataset_rights": DATASET_RIGHTS,
    "dashboard_rights": DASHBOARD_RIGHTS,
    "dataset_requests": DATASET_REQUESTS,
    "dashboard_requests": DASHBOARD_REQUESTS,
    "granted_shares": GRANTED_SHARES,
    "revoked_shares": REVOKED_SHARES,
    "without_error_dashboards": WITHOUT_ERROR_DASHBOARDS,
    "without_csv_datasets": WITHOUT_CSV_DATASETS,
    "without_debtors": WITHOUT_DEBTORS,
    "flipped_datasets": FLIPPED_DATASETS,
    "integrity": INTEGRITY,
    "rights_after_changes": RIGHTS_AFTER_CHANGES,
}
