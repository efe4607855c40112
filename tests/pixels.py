"""Pixels of runs, for comparing them with pictures."""


def pixel_set(df, *keys):
    return {
        (*[r[k] for k in keys], r["y"], x) for r in df.collect() for x in range(r["x0"], r["x1"])
    }
