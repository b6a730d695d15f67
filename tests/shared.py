"""What tests in several folders use."""

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def assert_same(df, con, sql):
    names = sorted(df.columns)
    found = con.execute(sql)
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    place = [order.index(n) for n in names]
    left = sorted(str([plain(v) for v in r]) for r in df.select(*[f"`{n}`" for n in names]).collect())
    right = sorted(str([plain(r[k]) for k in place]) for r in found.fetchall())
    assert left == right
