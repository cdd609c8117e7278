"""operators of tabloom."""
