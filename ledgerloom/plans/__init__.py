"""Whole jobs put together from operators, and the views the registered queries read."""
