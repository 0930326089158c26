"""Imports every module that registers operators."""

from brookline.operators import aggregate, filters, joins, ordered, project, reshape, sinks, windows
from brookline.sources import readers

MODULES = (aggregate, filters, joins, ordered, project, reshape, sinks, windows, readers)
