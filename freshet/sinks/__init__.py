"""Tables: the day-partitioned readings, versioned catalogues, alert history."""
