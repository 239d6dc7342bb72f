"""evalmill: language-model evaluation analytics as Spark jobs.

Tables of evaluation documents and tables of model outputs come in; prompts,
per-sample scores, corpus scores, uncertainty and leaderboards go out.
"""

__version__ = "0.1.0"
