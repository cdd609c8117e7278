"""functions of tabloom."""
