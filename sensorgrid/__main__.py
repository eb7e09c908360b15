from sensorgrid.jobs import main

main()
