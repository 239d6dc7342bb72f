"""User-defined metrics, metric groups, prompt functions and filters."""

from dataclasses import dataclass, field, replace
from typing import Any, Callable

from pyspark.sql import functions as F


@dataclass(frozen=True)
class MetricSpec:
    """A metric: sample Column(s) and how each is aggregated over a task.

    ``sample`` gets the parameters and returns a Column or a mapping
    name -> Column; ``corpus`` is an aggregate function or a mapping of them.
    """

    name: str
    sample: Callable[..., Any]
    corpus: Any = F.avg
    higher_is_better: bool = True
    params: dict = field(default_factory=dict)

    def with_params(self, **params):
        """Re-parametrised copy; the name gains ``:k=..&n=..``."""
        merged = {**self.params, **params}
        base = self.name.partition(":")[0]
        suffix = "&".join(f"{k}={merged[k]}" for k in sorted(merged))
        return replace(self, name=f"{base}:{suffix}" if suffix else base, params=merged)

    def columns(self):
        """Name -> sample Column."""
        out = self.sample(**self.params)
        return dict(out) if isinstance(out, dict) else {self.name: out}

    def aggregates(self):
        """Name -> corpus aggregate."""
        names = list(self.columns())
        return {n: (self.corpus[n] if isinstance(self.corpus, dict) else self.corpus) for n in names}


def score_samples(df, keys, specs):
    """Sample scores of all metrics in one projection."""
    cols = {n: c for s in specs for n, c in s.columns().items()}
    return df.select(*keys, *[c.alias(n) for n, c in cols.items()])


def score_tasks(samples, task, specs):
    """Corpus scores of all metrics in one aggregate."""
    aggs = {n: a for s in specs for n, a in s.aggregates().items()}
    return samples.groupBy(task).agg(*[a(F.col(f"`{n}`")).alias(n) for n, a in aggs.items()])


def batched_metric(df, fn, schema):
    """A metric over batches of samples: ``fn`` maps a pandas frame to a pandas frame."""

    def run(batches):
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def apply_prompt(rows, prompt_fn):
    """User function DataFrame -> DataFrame."""
    return rows.transform(prompt_fn)


def apply_filter(rows, predicate):
    """User predicate (a Column)."""
    return rows.filter(predicate)
