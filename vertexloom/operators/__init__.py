"""Graph operators: filters, reports, analytics and property write-back."""
