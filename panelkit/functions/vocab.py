"""Survey code labels, display names and scenario names.

These must equal the reference's values for equal results; they are data,
listed in natural order.
"""

# --- fixed values: answer-code labels per demographic question ---------------
CODE_LABELS = {
    "Gender": {"A1": "F", "A2": "M", "A3": "non-binary", "A4": "Prefer not to tell"},
    "Education": {"A1": "Secondary School", "A2": "Middle School", "A3": "High School", "A4": "College",
                  "A5": "Vocational training"},
    "Job": {"A1": "Student (school)", "A2": "Student (college)", "A3": "Employee", "A4": "Self-employed",
            "A5": "Jobseeker", "A6": "Other"},
    "DrivingFrequency": {"A1": "Daily", "A2": "On working days", "A3": "3-4 times a week", "A4": "1 time a week",
                         "A5": "1-3 times a month", "A6": "less than 1 time a month"},
    "Distance": {"A1": "less than 7.000km", "A2": "7.000 - 14.999km", "A3": "15.000 - 24.999km",
                 "A4": "25.000 - 32.999km", "A5": "33.000 or more km"},
}

# --- fixed values: display names of features and one-hot levels --------------
DISPLAY_NAMES = {
    "SCENARIO": "Scenario",
    "SCENARIO_NeueMitte": "Scenario: City",
    "SCENARIO_Ueberland": "Scenario: Cross-Country",
    "SCENARIO_Spielstrasse": "Scenario: Walking Speed Zone",
    "INTRODUCTION_boasting": "Introduction: boasting",
    "INTRODUCTION_ambiguous": "Introduction: ambiguous",
    "INTRODUCTION": "Introduction",
    "Gender_M": "Gender: Male",
    "Gender_non-binary": "Gender: non-binary",
    "Education_High School": "Education: High School",
    "Education_Vocational training": "Education: Vocational training",
    "Job_Jobseeker": "Job: Jobseeker",
    "Job_Other": "Job: Other",
    "Job_Self-employed": "Job: Self-employed",
    "Job_Student (college)": "Job: Student (college)",
    "License": "Driving License (years)",
    "DrivingFrequency": "Driving Frequency",
    "DrivingFrequency_1-3 times a month": "Driving Frequency: 1-3/month",
    "DrivingFrequency_3-4 times a week": "Driving Frequency: 3-4/week",
    "DrivingFrequency_Daily": "Driving Frequency: Daily",
    "DrivingFrequency_less than 1 time a month": "Driving Frequency: <1/month",
    "DrivingFrequency_On working days": "Driving Frequency: Working days",
    "Distance": "Distance",
    "Distance_25.000 - 32.999km": "Distance: 25.000 - 32.999km",
    "Distance_7.000 - 14.999km": "Distance: 7.000 - 14.999km",
    "Distance_less than 7.000km": "Distance: <7.000km",
    "Distance_33.000 or more km": "Distance: >=33.000km",
}
