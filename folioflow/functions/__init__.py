"""Functions from columns to a column."""
