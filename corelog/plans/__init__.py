"""corelog.plans"""
