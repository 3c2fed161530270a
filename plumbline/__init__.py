"""plumbline: profiles, log/web/spec/dependency digests and SQL guards expressed as Spark plans."""

__version__ = "0.1.0"
