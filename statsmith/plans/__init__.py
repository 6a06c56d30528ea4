"""Registered queries over the driver's tables (``catalog``) and the input
fixtures they read (``fixtures``); ``__spark_entry__`` exposes both."""
