"""sources of tabloom."""
