"""kohort: screening analytics (cleaning, clustering, risk mapping) as Spark jobs."""

__version__ = "0.1.0"
