"""Column functions for identifiers, labels, dates and time zones."""
