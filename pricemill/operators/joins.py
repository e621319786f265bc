"""Joins that treat NULL keys as equal, as a window or a group would."""

from functools import reduce

from pricemill.functions.windows import columns


def join_groups(df, groups, keys, how="inner"):
    """Join rows with per-group results on their group keys, NULL groups included."""
    keys = columns(keys)
    renamed = groups.withColumnsRenamed({k: f"_group_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"_group_{k}"]) for k in keys])
    return df.join(renamed, same, how).drop(*[f"_group_{k}" for k in keys])
