"""The registered queries; importing the package registers those of every module."""

from . import queries, sites, trails

__all__ = ["queries", "sites", "trails"]
