"""tickloom.plans"""
