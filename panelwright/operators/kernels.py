"""Functions of one group's pandas rows, for state that no window expresses. They run on executors and import nothing else of the package."""

from __future__ import annotations


def smoothed(pdf):
    """Exponential smoothing of close that restarts after a doubling."""
    import pandas as pd

    out, state = [], None
    for code, date, close in pdf.sort_values("date")[["code", "date", "close"]].itertuples(index=False):
        state = close if state is None or close > 2 * state else 0.9 * state + 0.1 * close
        out.append((code, date, round(state, 6)))
    return pd.DataFrame(out, columns=["code", "date", "value"])


def spaced_followers(pdf):
    """The ten largest bars at least five apart, greedily, and the mean over them of the volume of the five bars after over their own."""
    import pandas as pd

    pdf = pdf.sort_values("datetime").reset_index(drop=True)
    taken, out = [], []
    for i in sorted(range(len(pdf)), key=lambda i: (-pdf.vol[i], i)):
        if len(taken) == 10:
            break
        if all(abs(i - j) >= 5 for j in taken):
            taken.append(i)
            out.append(pdf.vol[i + 1 : i + 6].sum() / pdf.vol[i])
    return pd.DataFrame([(pdf.code[0], pdf.date[0], len(taken), round(float(pd.Series(out).mean()), 6))], columns=["code", "date", "n", "value"])
