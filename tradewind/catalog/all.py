"""Import every query module."""

from tradewind.catalog import analytics, connected, domain, live, models, preparation, sources, timeseries, trading  # noqa: F401
